"""The pipeline against a plain version of each stage, and the registered queries on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from weftspark.llm import decontam, langid, nearcopies, puquality, queries
from weftspark.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def brute_groups(rows):
    ids = sorted(rows)
    sets = {d: nearcopies.shingle_set(t, 5) for d, t in rows.items()}
    parent = {d: d for d in ids}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i in ids:
        for j in ids:
            if j < i and nearcopies.similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {d for d in ids if find(d) == d}


def test_pipeline(spark):
    docs = table(spark, SF_DIR, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.fit(docs)
    named, scores = langid._judge(model, list(texts.values()))
    one = {d: t for (d, t), n, s in zip(texts.items(), named, scores) if n != "und" and s >= 0.4}
    model = puquality.fit(docs.filter(docs.doc_id.isin(list(one))), table(spark, SF_DIR, "labels"))
    two = {d: t for d, t in one.items() if puquality._scores(model, [t])[0] >= 0.3}
    stay = brute_groups(two)
    three = {d: t for d, t in two.items() if d in stay}
    automaton = decontam.ItemAutomaton([(str(r["item_id"]), decontam.item_words(r["text"])) for r in table(spark, SF_DIR, "benchmark").collect()], 8)
    four = {}
    for d, t in three.items():
        spans, items, _ = automaton.hits(decontam.item_words(t))
        long = [s for s in decontam._merged(spans) if s[1] - s[0] >= 8]
        if len(items) <= 1 and sum(b - a for a, b in long) <= 0.5 * len(decontam.item_words(t)):
            four[d] = decontam.excise(t, long) if long else t
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in got} == set(four)
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 2
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns(spark, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF_DIR).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    quoted = ", ".join('"' + c + '"' for c in columns)
    want = con.execute(f"SELECT {quoted} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_every_document_has_its_rows(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    docs = table(spark, SF_DIR, "documents")
    assert df.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    if name != "op3_packing":
        assert df.count() == docs.count()


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for top, _, names in os.walk(os.path.join(root, "weftspark")):
        if os.path.basename(top) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert not re.search(r"weftspark\.llm|corpus_pipeline", open(os.path.join(top, n)).read())
