"""The pipeline on small data against plain Python, and the queries with SQL against DuckDB."""

import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline as P
from ordergate.llm import quality_crf as Q
from ordergate.llm.common import store, table
from ordergate.llm.registry import QUERIES, SQL
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_ngram_join import brute as components

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    scores = {r.doc_id: r.score for r in Q.classify(docs, table(spark, SF, "labels")).collect()}
    want = {i: t for i, t in rows.items() if scores[i] >= 0.7}
    last = {t.encode().lower(): max(j for j, u in want.items() if u.encode().lower() == t.encode().lower()) for t in want.values()}
    steps = [want, {i: t for i, t in want.items() if last[t.encode().lower()] == i}]
    near = components(list(steps[1].items()), P.NEAR_SHINGLE, P.NEAR_PERCENT)
    steps.append({i: t for i, t in steps[1].items() if near[i][1] == i})
    steps.append({i: t for i, t in steps[2].items() if not contamination(t, items)[-1]})
    assert len(rows) > len(steps[0]) > len(steps[1]) > len(steps[3]) > 0
    for (name, stage), kept in zip(P.STAGES, steps):
        docs = store(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        assert {r.doc_id: r.text for r in docs.collect()} == kept, name
    pieces = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(steps[3])
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert sorted((p.doc_id, p.start, p.ids_crc32) for p in P.run(spark, SF).collect()) == sorted((p.doc_id, p.start, p.ids_crc32) for p in pieces)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, rel.fetchall()))


def test_registry_without_this_subpackage():
    """The other queries load where the subpackage and the pipeline are not there."""
    code = ("import sys\nclass Gone:\n def find_spec(self, name, path=None, target=None):\n"
            "  if name == 'corpus_pipeline' or name.startswith('ordergate.llm'): raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\n"
            "q = e.queries(); assert 'verdicts' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=REPO)
