import os
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veritrack.llm import queries
from veritrack.llm.mixing import TARGETS, cell_weights, keyword_topic, mix_sources
from veritrack.llm.quotes import conversations, link_quotes

SF = "/root/testdata/sf0.001"


def test_quotes(spark):
    rows = [(1, 0, "u", "Hello there\nHow are  you?\n\nBye"), (1, 1, "a", "> Hello there\n> how are you?\nI am fine\nthanks"), (1, 2, "u", "> > Hello there\n> I am fine\nGood\n> unknown thing"),
            (1, 3, "u", None), (1, 4, "a", ">Good\nok >not quote"), (1, 5, "a", "> later\nx"), (1, 6, "u", "later"), (2, 0, "u", ""), (None, 0, "u", "> x\ny"), (2, 1, "u", "solo"), (2, 1, "u", "solo"), (3, 1, "u", "> Hello there\nz")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    got = {(r.conv_id, r.turn): (r.own_text, r.n_quoted, r.n_linked, r.reply_to, r.depth, r.root_turn) for r in link_quotes(df).collect()}
    assert got[1, 1] == ("I am fine\nthanks", 1, 1, 0, 1, 0)
    assert got[1, 2] == ("Good", 3, 2, 1, 2, 0)
    assert got[1, 4] == ("ok >not quote", 1, 1, 2, 3, 0)
    assert got[1, 3] == (None, 0, 0, None, 0, 3)
    assert got[1, 5][2:4] == (0, None)  # only an earlier message can be quoted
    assert got[3, 1][2:4] == (0, None) and got[None, 0][0] == "y"
    assert link_quotes(df).count() == len(rows) and link_quotes(df.limit(0)).count() == 0


def plain_threads(rows):
    """The rules of link_quotes in plain Python: own text, quoted, linked, reply, depth and root of each message."""
    def clean(text):
        return " ".join(x for x in re.split(r"[ \t\r\f\x0B\n]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x)

    def spans(text):
        out = []
        for line in (text or "").split("\n"):
            marks = re.match(r"[ \t]*(>[ \t>]*)?", line)
            level = (marks[1] or "").count(">")
            body = line[marks.end():] if level else line
            if out and out[-1][0] == level:
                out[-1][1].append(body)
            else:
                out.append((level, [body]))
        return out

    def keys(bodies):
        return {k for k in (clean("\n".join(bodies)), *map(clean, bodies)) if k}

    origin, parsed, result = {}, {}, {}
    for conv, turn, _, text in rows:
        parsed[conv, turn] = spans(text)
    for (conv, turn), parts in sorted(parsed.items()):
        for level, bodies in parts:
            for k in keys(bodies) if not level else ():
                origin.setdefault((conv, k), turn)
    for (conv, turn), parts in sorted(parsed.items()):
        quoted = {(level, clean("\n".join(b)), frozenset(keys(b))) for level, b in parts if level and keys(b)}
        links = {}
        for level, whole, ks in quoted:
            at = origin.get((conv, whole), turn)
            lines = [origin[conv, k] for k in ks if origin.get((conv, k), turn) < turn]
            if lines:
                links[level, whole] = max(links.get((level, whole), -1), at if at < turn else max(lines))
        reply = max((o for (level, _), o in links.items() if level == min(x for x, _ in links)), default=None)
        depth, root = (result[conv, reply][4] + 1, result[conv, reply][5]) if reply is not None else (0, turn)
        result[conv, turn] = ("\n".join(x for level, b in parts if not level for x in b), len({w for _, w, _ in quoted}), len({w for _, w in links}), reply, depth, root)
    return result


def test_threads_equal_a_plain_version(spark):
    draw, rows = random.Random(7), []
    for conv in range(30):
        said = []
        for turn in range(draw.randint(1, 12)):
            lines = []
            for _ in range(draw.randint(1, 5)):
                if said and draw.random() < 0.5:
                    quote = draw.choice(said).split("\n")
                    lines += [draw.choice([">", "> ", " > > ", ">>"]) + x for x in quote[: draw.randint(1, len(quote))]]
                else:
                    lines.append(" ".join(draw.choice(["Alpha", "beta", "C", "d  d", ""]) for _ in range(draw.randint(1, 4))))
            said.append("\n".join(lines))
            rows.append((conv, turn, "u", said[-1]))
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {(r.conv_id, r.turn): tuple(r)[3:9] for r in got.collect()} == plain_threads(rows)
    threads = conversations(got).collect()
    assert sum(len(t.messages) for t in threads) == len(rows)
    for t in threads:
        assert [m.position for m in t.messages] == list(range(len(t.messages))) and [m.turn for m in t.messages] == sorted(m.turn for m in t.messages)
        assert all(">" not in m.own_text for m in t.messages)


def test_long_message_takes_linear_work(spark):
    long = "\n".join("> line %d" % i if i % 3 else "own %d" % i for i in range(10_000))
    rows = [(1, 0, "u", "\n".join("line %d" % i for i in range(10_000))), (1, 1, "a", long)]
    began = time.time()
    got = {r.turn: r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].n_quoted == got[1].n_linked == 3333 and got[1].reply_to == 0 and got[1].position == 1
    assert time.time() - began < 60


def test_margins_are_met(spark):
    rows = [(f"src{i % 3}", ("en", "de", "xx")[i % 2], ("short", "medium", "long")[i // 6 % 3], 10 + 7 * i % 90) for i in range(200)]
    cells = cell_weights(spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")).toPandas()
    assert cells.rounds.max() < 200 and cells.margin_error.max() < 1e-6
    for d in ("source", "lang", "topic"):
        share = cells.groupby(d).weight.sum() / cells.weight.sum()
        want = {k: TARGETS[d].get(k, 0) for k in share.index}
        for k in share.index:
            assert share[k] == pytest.approx(want[k] / sum(want.values()), abs=1e-5)


def test_given_tokens_and_topics(spark):
    rows = [(i, 'source words' if i % 2 else 'a court and its law law', 'en', 'src0', 10 + i) for i in range(40)]
    df = spark.createDataFrame(rows, 'doc_id long, text string, lang string, source string, n long')
    topics = keyword_topic(F.col('text'), {'law': ('law', 'court'), 'code': ('source', 'build')})
    targets = {'source': {'src0': 1.0}, 'lang': {'en': 1.0}, 'topic': {'law': 0.25, 'code': 0.75}}
    got = mix_sources(df, targets, tokens=F.col('n'), topics=topics).toPandas()
    assert set(got.topic) == {'law', 'code'} and (got.n_tokens == got.n).all()
    weight = (got.chance * got.n).groupby(got.topic).sum()
    assert weight['code'] / weight['law'] == pytest.approx(3, rel=1e-3)
    none = spark.createDataFrame([(None,), ('nothing',)], 'text string').select(keyword_topic(F.col('text'), {'law': ('law',)}).alias('t'))
    assert {r.t for r in none.collect()} == {'other'}


def test_mixing_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "src0"), (None, "a b", "en", "src0"), (3, "a b c", "zz", "new"), (4, "word " * 2000, "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("chance", F.lit(7))
    got = {r.doc_id: r for r in mix_sources(df).collect()}
    assert len(got) == 5 and not got[None].sampled and 0 <= got[4].chance <= 1
    assert mix_sources(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(out) < n and len({r.doc_id for r in out}) == len(out)
    odd = spark.createDataFrame([(None, "a b", None, None, None), (1, None, None, None, None), (2, "", "en", "src0", 0)], docs.schema)
    clash = odd.withColumn("score", F.lit("mine")).withColumn("component_id", F.lit("mine")).withColumn("chance", F.lit(True))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
        stage(spark, docs.limit(0), SF).collect()
        assert stage(spark, clash, SF).columns == stage(spark, odd, SF).columns


def test_stages_judge_each_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.orderBy("doc_id").where("length(text) > 500").limit(3)
    many = one.union(one).union(one.withColumn("doc_id", F.lit(None).cast("long")))
    languages = {r.text: r.n for r in corpus_pipeline.language_stage(spark, docs.union(many), SF).groupBy("text").agg(F.count("*").alias("n")).collect()}
    assert all(languages.get(r.text, 4) >= 4 for r in one.collect())
    left = corpus_pipeline.near_dup_stage(spark, many, SF).collect()
    assert len(left) == len({r.doc_id for r in left if r.doc_id is not None}) + 3 and len({r.doc_id for r in left if r.doc_id is not None}) <= 3
