"""The corpus pipeline against a plain model of its stages, and the training queries against their SQL."""

import re
import zlib
from collections import defaultdict
from itertools import combinations

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import quality
from lectern.llm.queries import QUERIES, oracle_sql

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = con.execute(oracle_sql()[name])
    theirs = [d[0] for d in got.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def near_model(docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        if w:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: t for i, t in docs.items() if i not in sets or find(i) == i}


def leak_model(docs, bench):
    word = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = set()
    for t in bench:
        w = re.findall(word, lower(t))
        k = min(13, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1 if k else 0)}
    out = {}
    for i, t in docs.items():
        m = list(re.finditer(word, lower(t)))
        w = [x[0] for x in m]
        hit = set()
        for k in {len(x) for x in windows}:
            hit |= {j + d for j in range(len(w) - k + 1) if tuple(w[j : j + k]) in windows for d in range(k)}
        if hit and 20 * len(hit) >= len(w):
            continue
        for j in sorted(hit, reverse=True):
            start = m[j - 1].end() if j - 1 in hit else m[j].start()
            t = t[:start] + t[m[j].end() :]
        out[i] = t
    return out


def test_stages(spark, con):
    docs = dict(con.execute("select doc_id, text from documents").fetchall())
    kept = {r[0] for r in con.execute(f"select doc_id from ({oracle_sql()['op9_quality_rules']}) where kept").fetchall()}
    bench = [r[0] for r in con.execute("select text from benchmark").fetchall()]
    first = {i: t for i, t in docs.items() if i in kept}
    second = near_model(first)
    third = leak_model(second, bench)
    assert len(docs) > len(first) > len(second) > len(third) > 0

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    at = table
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], (first, second, third), strict=True):
        at = spark.createDataFrame(stage(spark, at, SMALL).collect(), table.schema)
        rows = at.collect()
        assert {r.doc_id: r.text for r in rows} == want and len(rows) == len(want)
        assert all(r.n_chars == len(r.text) for r in rows)
        at.createOrReplaceTempView("stage")

    packed = corpus_pipeline.run(spark, SMALL).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in third.items()}
    tokens, places = defaultdict(int), defaultdict(list)
    for r in packed:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        tokens[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert tokens == {i: len(x) for i, x in ids.items()}
    for p in places.values():
        ends = [a + n for a, n in sorted(p)]
        assert [a for a, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_stages_take_odd_rows(spark):
    rows = [(None, None, "en", None, None), (1, "", "en", "s", 0), (2, "x " * 60, None, "s", 120), (2, "words that differ here " * 3 + "and so on, more " + "of them " * 2, "en", "s", 80), (None, " ".join(f"word{i}" for i in range(40)), "en", "s", -1), (2, None, None, None, None)]
    at = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as failures", "'a' as row", "2 as hit_spans", "3 as n_words", "4 as _t", "5 as _row", "6 as n_hit", "7 as doc", "8 as was_cut")
    own = set(at.select("failures", "row", "hit_spans", "n_words", "_t", "_row", "n_hit", "doc", "was_cut").collect())
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, at, SMALL)
        assert out.columns == at.columns and {*out.select("failures", "row", "hit_spans", "n_words", "_t", "_row", "n_hit", "doc", "was_cut").collect()} <= own
        at = spark.createDataFrame(out.collect(), at.schema)
    assert corpus_pipeline.STAGES[3][1](spark, at, SMALL).count() == at.count()
    assert quality.POLICY in quality.POLICIES
