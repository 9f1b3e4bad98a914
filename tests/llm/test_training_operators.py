"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns whose names clash."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import chat, decontam, html_text, licenses, neardup, packing, quality, sharding, token_counts, token_store
from lectern.llm.encode import encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
CLASH = "part int, n_words string, text_crc32 string, fp string, row string, hit_items string, failures string, bands string, size string, ids string"


def documents(spark, rows):
    """rows of (doc_id, text), with columns that operators might use themselves."""
    extra = (1, "a", "b", "c", "d", "e", "f", "g", "h", "i")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASH}")


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "délta", "cc", "by", "BY", "general", "public", "license", "all", "rights", "reserved", "x1", "#", "—", "the", "omega"]
    out = []
    for i in range(n):
        kind = rng.randrange(8)
        if kind == 0 and out:
            text = rng.choice(out)[1]
        elif kind == 1 and out:
            text = (rng.choice(out)[1] or "") + " tail"
        elif kind == 2:
            text = rng.choice([None, "", "\n", "one", " cc by ", "x y z"])
        else:
            text = rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randrange(1, 120)))
        out.append((rng.choice([i, i, i, None]) if seed % 2 else i, text))
    return out


@pytest.fixture(scope="module")
def big(spark):
    rows = corpus(2) + [(1000, "long " * 30_000 + "end"), (1001, "w" * 100_000), (1002, "abc <|endoftext|> def"), (1003, "x<|startoftext|><|ENDOFTEXT|>")]
    return rows, documents(spark, rows).repartition(3).cache()


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def alnum(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def spaced(text, fold=True):
    lower = "".join(chr(ord(c) + 32) if fold and "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lower)


# 1


def license_model(text):
    """Every line, and every run of a template's width from one of its words on."""
    own = alnum(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
    labels, share = set(), 0.0
    lines = [set(alnum(line)) for line in (text or "").split("\n")]
    every = set(own)
    for label, statement in licenses.TEMPLATES:
        t, width = set(alnum(statement)), licenses.window(statement)
        if 10 * len(t & every) < 9 * len(t):
            continue
        for block in lines + [set(own[i : i + width]) for i in range(len(own)) if own[i] in t]:
            if 10 * len(t & block) >= 9 * len(t) and block >= t & licenses.TELLING and block.isdisjoint(licenses.NEVER.get(label, ())):
                labels.add(label)
                share = max(share, len(t & block) / len(t))
    base = {x[1] for x in places}
    starts = [x[0] for x in places]
    return len(own), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else share


def test_licenses(spark, big):
    rows, df = big
    more = [(2000 + i, f"intro\n{s.upper()} ok\nend") for i, (_, s) in enumerate(licenses.TEMPLATES)] + [(3000, "Licensed under the Apache License\nVersion 2.0")]
    got = licenses.scan(df.union(documents(spark, more))).drop("blocks")
    assert as_rows(got) == sorted(((i, *license_model(t)) for i, t in rows + more), key=repr)
    assert licenses.scan(documents(spark, [])).count() == 0


def test_wrapped_licenses(spark):
    rng = random.Random(1)
    rows = [
        (1, "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated files"),
        (2, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"),
        (3, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."),
        (4, "Licensed under the Apache License\nVersion 2.0"),
        (5, "Licensed under the Apache License\n" + "some other words in between\n" * 3 + "Version 2.0"),
        (6, None),
    ]
    for k, (_, s) in enumerate(licenses.TEMPLATES * 6):
        own = s.split()
        del own[rng.randrange(len(own))]
        for _ in range(rng.randrange(4)):
            own.insert(rng.randrange(len(own)), rng.choice(["rem", "sa", "nc", "2"]))
        rows.append((100 + k, "".join(["the x\n", *(w + rng.choice(" \n") for w in own), "\nof the end"])))
    got = {r.doc_id: r for r in licenses.scan(documents(spark, rows)).collect()}
    assert {i: tuple(got[i])[1:8] for i in got} == {i: license_model(t) for i, t in rows}
    assert [got[i].labels for i in range(1, 7)] == ["mit", "bsd", "mpl-2.0", "apache-2.0", "", ""]
    assert [tuple(b) for b in got[4].blocks] == [(0, "apache-2.0", 1.0)]


def test_kin_of_licenses():
    join = licenses.Join(licenses.word_sets(), {})
    of = lambda s: sorted(join.labels(set(licenses.words(s.encode()))))
    gpl = "This work is licensed under the GNU General Public License version "
    assert of(gpl + "2") == ["gpl-2.0"] and of(gpl + "3") == ["gpl-3.0"]
    for label, s in licenses.TEMPLATES:
        if label.startswith("cc-by"):
            assert of(s) == [label]


def test_license_filters():
    """The filters lose nothing, and the places in both orders prune what the prefix alone lets through."""
    rng = random.Random(4)
    pool = [f"w{i}".encode() for i in range(24)]
    pruned = 0
    for _ in range(300):
        sets = [(f"l{k}", tuple(sorted(rng.sample(pool, rng.randrange(2, 14))))) for k in range(6)]
        join = licenses.Join(sets, {w: rng.randrange(5) for w in pool})
        block = set(rng.sample(pool, rng.randrange(1, 20)))
        passed = list(join.candidates(block))
        assert len(passed) == len(set(passed))
        assert {t for t, _ in join.held(block)} == {t for t, (_, own) in enumerate(sets) if 10 * len(block & set(own)) >= 9 * len(own)} <= set(passed)
        pruned += len({t for w in block & set(pool) for t, _ in join.prefix.get(join.rank.get(w), ())}) - len(passed)
    assert pruned > 100


# 2


tokenizer = cache(Tokenizer.from_file)


def token_ids(path, text, end):
    return [*tokenizer(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("capacity", [16, 100])
def test_packing(big, capacity):
    rows, df = big
    got = packing.pack(df, BYTE, capacity).collect()
    want = Counter()
    for i, t in rows:
        ids = token_ids(BYTE, t, 0)
        for piece, (start, n) in enumerate(packing.cut(len(ids), capacity)):
            want[(i, piece, start, n, crc(ids[start : start + n]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(by) <= 1.02 * -(-sum(r.length for r in got) // capacity) + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.integers(1, 60))
def test_fullest(lengths, room):
    counts = Counter(lengths)
    need = packing.fullest(sorted((x for x in counts if x <= room), reverse=True), counts, room)
    reach = {0}
    for x in lengths:
        reach |= {y + x for y in reach if y + x <= room}
    assert sum(x * k for x, k in need.items()) == max(reach)
    assert all(k <= counts[x] for x, k in need.items())


@given(st.integers(1, 500), st.integers(1, 50))
def test_cut(n, capacity):
    pieces = list(packing.cut(n, capacity))
    assert sum(x for _, x in pieces) == n and all(x == capacity for _, x in pieces[1:])
    assert [s for s, _ in pieces] == [sum(x for _, x in pieces[:i]) for i in range(len(pieces))]
    assert n > capacity or len(pieces) == 1


def test_empty_packing(spark):
    assert packing.pack(documents(spark, []), BYTE).count() == 0


# 3


def test_sharding(spark, big):
    rows, df = big
    got = sharding.shard(df).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [r.doc_id if r.doc_id is not None else -1 for r in order]
    assert ids == sorted(ids)
    total = sum(r.size for r in got)
    by, at = defaultdict(list), 0
    for r in order:
        by[r.shard].append(r.slot)
        assert r.shard == min(7, (2 * at + r.size) * 8 // (2 * total))
        at += r.size
    assert all(v == list(range(len(v))) for v in by.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard(documents(spark, [])).count() == 0


# 4


def shingle_set(text, size):
    w = spaced(text)
    return frozenset() if not w else frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def class_model(rows, size):
    sets = [shingle_set(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            up[find(a)] = find(b)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    pick = lambda ids: min((x for x in ids if x is not None), default=None)
    return sets, [pick(least[find(i)]) for i in range(len(rows))]


def chain(seed):
    """Copies, near copies in chains, and a crowd of texts that share most of their words without being near."""
    rng = random.Random(seed)
    out, base = [], [f"t{rng.randrange(400)}" for _ in range(120)]
    for k in range(40):
        out.append((len(out), " ".join(base)))
        if k % 3 == 0:
            out.append((len(out), "\n".join(base).upper()))
        base[rng.randrange(120)] = f"u{k}"
        base[rng.randrange(120)] = f"v{k}"
    common = [f"c{i}" for i in range(60)]
    for k in range(30):
        own = common + [f"k{k}_{i}" for i in range(rng.randrange(8, 30))]
        out.append((len(out), " ".join(own)))
    return out


@pytest.mark.parametrize(("rows", "size"), [(chain(1), 4), (corpus(3, 60), 5)])
def test_near_duplicates(spark, rows, size):
    got = neardup.near_duplicates(documents(spark, rows).repartition(3), size).select("doc_id", "n_shingles", "component_id", "kept")
    sets, least = class_model(rows, size)
    assert as_rows(got) == sorted(((i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, least, strict=True)), key=repr)


def test_keep_one(spark, tmp_path):
    rows = corpus(4, 50)
    documents(spark, rows).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    sets, least = class_model(rows, 5)
    want = sorted((i for (i, _), s, c in zip(rows, sets, least, strict=True) if not s or i == c), key=repr)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_many_with_one_key(spark, monkeypatch):
    """Joins and self-joins in slices: nothing is lost, none is twice."""
    from lectern.llm import common

    monkeypatch.setattr(common, "FEW", 3)
    monkeypatch.setattr(neardup, "SLICE", 2)
    rows = chain(5) + [(1000 + k, "the same words for many a document of this kind") for k in range(40)] + [(None, None), (None, ""), (None, "the same words for many")]
    got = neardup.near_duplicates(documents(spark, rows).repartition(3), 4).select("doc_id", "n_shingles", "component_id", "kept")
    sets, least = class_model(rows, 4)
    assert as_rows(got) == sorted(((i, len(s), c if s else i, i == (c if s else i)) for (i, _), s, c in zip(rows, sets, least, strict=True)), key=repr)
    a = spark.createDataFrame([(k % 3 if k < 60 else k, k) for k in range(70)] + [(None, 1)] * 9, "by long, v long")
    b = spark.createDataFrame([(k, str(k)) for k in range(0, 65, 2)], "by long, name string")
    for how in ("inner", "left"):
        assert as_rows(common.spread(a, b, "by", how)) == as_rows(a.join(b, "by", how))


def test_rows_without_ids(spark):
    rows = [(None, t) for _, t in chain(6)]
    got = neardup.near_duplicates(documents(spark, rows), 5)
    sets, _ = class_model(rows, 5)
    _, classes = class_model([(i, t) for i, (_, t) in enumerate(rows)], 5)
    assert sorted(Counter(r.class_id for r in got.collect()).values()) == sorted(Counter(classes).values()) and len(sets) == len(rows)


def test_columns_of_keep_one(spark, tmp_path):
    """Other columns come back as they were, and splits may change between two readings of the table."""
    rows = [(i, t, -1, "r", 2) for i, t in corpus(4, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long, row string, `doc` int")
    df.repartition(3).write.parquet(str(tmp_path / "d"))
    kept = neardup.keep_one(spark.read.parquet(str(tmp_path / "d")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = kept.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    sets, least = class_model([r[:2] for r in rows], 5)
    assert {tuple(r)[2:] for r in got} == {(-1, "r", 2)} and kept.columns == df.columns
    assert sorted((r.doc_id for r in got), key=repr) == sorted((r[0] for r, s, c in zip(rows, sets, least, strict=True) if not s or r[0] == c), key=repr)


def test_no_documents(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    assert neardup.near_duplicates(documents(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_densified_sketches_agree():
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 2**63, 60, np.uint64) * np.uint64(2))
    a = neardup.bands(hashes)
    assert (a == neardup.bands(hashes.copy())).all() and len(a) == neardup.BANDS
    near = 0
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, 90, np.uint64) * np.uint64(2) + np.uint64(1))
        y = np.unique(np.concatenate([x[:80], rng.integers(0, 2**63, 5, np.uint64)]))
        near += bool((neardup.bands(x) == neardup.bands(y)).any())
    assert near == 200


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    up = {x: x for e in edges for x in e}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert neardup.components(spark.createDataFrame([], "a long, b long")) is None


# 5


def test_token_counts(spark, big):
    rows, df = big
    lengths = [len(token_ids(BYTE, t, 0)) - 1 for _, t in rows]
    h = token_counts.lengths(df, BYTE).cache()
    got = {r.length: r for r in token_counts.limits(h).collect()}
    assert set(got) == set(lengths)
    for c, r in got.items():
        assert (r.n_docs, r.docs_fit, r.docs_over) == (lengths.count(c), sum(x <= c for x in lengths), sum(x > c for x in lengths))
        assert (r.n_tokens, r.tokens_fit) == (c * lengths.count(c), sum(x for x in lengths if x <= c))
        assert r.truncated_total == sum(min(x, c) for x in lengths) and r.share_fit == pytest.approx(r.docs_fit / len(rows))
    assert tuple(token_counts.total(h).first()) == (len(rows), sum(lengths))
    for c in (0, 7, 2048, 10**9):
        assert token_counts.truncated_total(h, c).first()[0] == sum(min(x, c) for x in lengths)
    for q in (0.1, 0.5, 1.0):
        assert token_counts.quantile(h, q).first()[0] == sorted(lengths)[max(0, int(np.ceil(q * len(lengths) - 1e-9)) - 1)]
    none = token_counts.lengths(documents(spark, []), BYTE)
    assert token_counts.limits(none).count() == 0 and tuple(token_counts.total(none).first()) == (0, 0) and token_counts.quantile(none, 0.5).count() == 0


# 6


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["don't", "I'LL", "naïve", "ÉTÉ", "x1y22", "  ", "\n\n", "\t", "…", "<|endoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endoftext", "日本", "Ⅷ", "'s", "²", "é", " ", "ß", "İ", "word."]), max_size=10).map(" ".join)))
def test_encoder(path, text):
    t = tokenizer(path)
    assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_token_store(spark, big, tmp_path):
    rows, df = big
    got = token_store.export_then_digest(df, WORD, 2).collect()
    want = Counter((i, len(ids := token_ids(WORD, t, 2)), crc(ids)) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)
    assert token_store.export_then_digest(documents(spark, []), WORD, 2).count() == 0


def test_segments():
    frames, dictionary = [], b""
    import zstandard

    docs = [[1, 2, 3], [70_000], []]
    for i, ids in enumerate(docs):
        frames.append((None if i == 1 else i, len(ids), zstandard.ZstdCompressor().compress(np.array(ids, "<u4").tobytes())))
    seg = token_store.Segment(token_store.pack_segment(frames, 4, hashlib.sha256(dictionary).digest()), dictionary)
    assert [seg.ids(i).tolist() for i in range(3)] == docs
    with pytest.raises(ValueError, match="another dictionary"):
        token_store.Segment(token_store.pack_segment(frames, 4, b"x" * 32), dictionary)


# 7


def test_viterbi_in_pieces():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 14))
        scores, step, start = rng.normal(size=(n, 3)).tolist(), rng.normal(size=(3, 3)).tolist(), rng.normal(size=3).tolist()
        best, score = chat.viterbi(scores, start, step, None, None)
        cuts = sorted({0, *rng.integers(0, n, 2).tolist()})
        parts = [scores[a:b] for a, b in zip(cuts, [*cuts[1:], n], strict=True)]
        edges = chat.boundaries([(k, chat.transfer(p, step, start)) for k, p in enumerate(parts)])
        joined = [s for p, (_, before, last) in zip(parts, edges, strict=True) for s in chat.viterbi(p, start, step, before, last)[0]]
        assert joined == best
        total = start[best[0]] + sum(scores[i][s] for i, s in enumerate(best)) + sum(step[a][b] for a, b in zip(best, best[1:]))
        assert total == pytest.approx(score)


def test_viterbi_against_all_paths():
    """Every path of states is scored by itself."""
    rng = np.random.default_rng(11)
    for _ in range(40):
        n = int(rng.integers(1, 7))
        scores, step, start = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        of = lambda p: start[p[0]] + sum(scores[i, s] for i, s in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(product(range(3), repeat=n), key=of)
        path, score = chat.viterbi(scores.tolist(), start.tolist(), step.tolist(), None, None)
        assert tuple(path) == best and score == pytest.approx(of(best))


def test_query_against_all_paths(spark):
    """Roles of whole conversations, decoded by trying all paths of a model that is read off the fitted one."""
    rng = random.Random(3)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant" if c % 3 else None, rng.choice(["Is it?", "It is.\n- a\n- b", "words " * 40, "Human: so?", ""])) for c in range(30) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.train(chat.split_units(df).cache())
    got = {(r.conv_id, r.turn, r.segment): r.role_found for r in chat.recover(df.repartition(3)).collect()}
    for c in range(30):
        own = [(t, k, codes) for _, t, _, text in sorted(r for r in rows if r[0] == c) for k, (_, codes) in enumerate(chat.units(text))]
        scores = [[sum(model.emission[code, s] for code in codes) for s in range(3)] for _, _, codes in own]
        of = lambda p: model.start[p[0]] + sum(scores[i][s] for i, s in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = of(max(product(range(3), repeat=len(own)), key=of))
        found = [chat.ROLES.index(got[c, t, k]) for t, k, _ in own]
        assert of(found) == pytest.approx(best)


def test_chat_roles(spark):
    rows = []
    for c in range(60):
        for t in range(6):
            user = t % 2 == 0
            text = "What about this?" if user else "It is so.\n- one thing\n- another thing\n" + "words " * 30
            rows.append((c, t, "user" if user else "assistant", text))
    labelled, held = rows[:300], rows[300:]
    hidden = [(c, t, None, x) for c, t, _, x in held]
    df = spark.createDataFrame(labelled + hidden + [(99, 0, None, "User: hi?\nAssistant: hello\nUser: bye"), (99, 1, "odd", None), (None, None, None, "System: be kind")], "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("x"))
    got = {(r.conv_id, r.turn, r.segment): r for r in chat.recover(df.repartition(3)).collect()}
    right = sum(got[(c, t, 0)].role_found == r for c, t, r, _ in held)
    assert right >= 0.9 * len(held)
    assert [got[(99, 0, s)].role_found for s in range(3)] == ["user", "assistant", "user"]
    assert got[(99, 0, 1)].rendered == "<|assistant|>\nhello\n<|end|>\n"
    assert got[(99, 1, 0)].rendered.endswith("|>\n\n<|end|>\n") and got[(None, None, 0)].role_found == "system"
    assert chat.recover(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["few labels", "one conversation", "no turns"])
def test_sample_of_labelled_rows(spark, monkeypatch, kind):
    if kind == "few labels":
        rows = [(c, t, "user" if t % 2 == 0 else "assistant") if c % 20 == 0 else (c, t, None) for c in range(400) for t in range(10)]
    else:
        rows = [(7, t if kind == "one conversation" else None, "user" if t % 2 == 0 else "assistant") for t in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string")
    fitted, fit = [], chat.fit
    monkeypatch.setattr(chat, "SAMPLE_ROWS", 120)
    monkeypatch.setattr(chat, "SAMPLE_TURNS", 9)
    monkeypatch.setattr(chat, "fit", lambda sample: fitted.extend(sample) or fit(sample))
    model = chat.train(chat.split_units(df).cache())
    assert len(fitted) == 120
    step = np.exp(model.step)
    if kind == "one conversation":  # runs of nine turns: what is not next to each other must not count as a step
        assert 0 < sum(not joined for *_, joined in fitted) < 120
        assert step[1, 2] > 10 * step[1, 1] and step[2, 1] > 10 * step[2, 2]
        starts = np.exp(model.start) / np.exp(model.start).min()
        assert starts.sum() < 4.5


def test_chunks_do_not_change_roles(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a?", "b " * 80, "- c", "AI: d", ""])) for c in range(4) for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").cache()
    whole = as_rows(chat.recover(df))
    monkeypatch.setattr(chat, "CHUNK", 7)
    assert as_rows(chat.recover(df)) == whole
    monkeypatch.setattr(chat, "CHUNK", 1000)
    monkeypatch.setattr(chat, "CHUNK_CHARS", 300)
    assert chat.split_units(df).select("chunk").distinct().count() > 10
    assert as_rows(chat.recover(df)) == whole


# 8


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>One<p>Two <b>bold</b>&amp;", "One\n\nTwo bold&"),
        ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"),
        ("<table><tr><th>k<th>value<tr><td>long key<td>v</table>", "k        | value\nlong key | v"),
        ("<div hidden>no</div><p style='display: none'>no</p>yes<script>x</script>", "yes"),
        ("a<br>b <!-- c --> d", "a\nb d"),
        ("<pre>  x\n  y</pre>z", "  x\n  y\n\nz"),
        ("<head><title>t</title></head><body>b", "b"),
        ("text < 5 and <unclosed", "text < 5 and <unclosed"),
        ("", ""),
        (None, ""),
        ("<div>" * 5000 + "deep", "deep"),
        ("<td>stray</td>", "stray"),
    ],
)
def test_html(spark, html, text):
    assert html_text.page_text(html or "") == text
    df = spark.createDataFrame([(1, html, "u")], "page_id long, html string, text string")
    assert html_text.extract(df).first().text == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>T</title><p>Hello", "Hello"),
        ("<head><meta charset=x><style>s</style> \n Hello <b>you</b>", "Hello you"),
        ("<head><head><title>T</title><noscript><img alt=no></noscript><script>s</script></head><body>b", "b"),
        ("<head><link rel=x><div>a</div></head><title>T</title><p>b", "a\n\nb"),
    ],
)
def test_open_head(html, text):
    assert html_text.page_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> holds", "so x=2 holds"),
        ("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><text>North</text><text>South</text></svg>", "North South"),
        ("a<svg><title/><style/><path d='M0'/></svg>b", "ab"),
        ("<select><option>red<option>green</select>", "red\ngreen"),
        ("<datalist><option>no</datalist><desc>shown</desc>", "shown"),
    ],
)
def test_drawn_text(html, text):
    assert html_text.page_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<a title=it's>Bob</a> said it doesn't. <b>x", "Bob said it doesn't. x"),
        ("<a title='it's hidden'>shown</a>", "shown"),
        ("<a x=5\">one</a> is 5\" <i>two</i>", "one is 5\" two"),
        ("<p title = \"a > b\" id='>'>text", "text"),
        ("<p style=display:none>no</p><p =' hidden>no</p><p class= >yes", "yes"),
        ("<a title=\"open>kept", "kept"),
        ("<img alt=\"it's\"><img alt=o'clock>", "it's o'clock"),
    ],
)
def test_quotes_in_tags(html, text):
    assert html_text.page_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><td colspan=2>both<tr><td>a<td>b</table>", "both\na | b"),
        ("<table><tr><td rowspan=2>l<td>x<tr><td>y</table>", "l | x\n  | y"),
        ("<table><tr><th colspan=3>a long heading<tr><td>1<td>2<td>3</table>", "a long heading\n1 | 2 | 3"),
        ("<table><tr><td>1<td colspan=2>wide<td>4<tr><td>a<td>b<td>c<td>d</table>", "1 | wide  | 4\na | b | c | d"),
        ("<table><tr><td colspan=0>a<td rowspan=x>b</table>", "a | b"),
        ("<a title=\"x>link</a> more", "link more"),
        ("<a title='x < y > z'>link</a>", "link"),
    ],
)
def test_spans_and_open_quotes(html, text):
    assert html_text.page_text(html) == text


@pytest.mark.parametrize("piece", ['<a b="', '<a x="" <b ', ' x="<c"', "<a b='>\"", "<p><td><b><hr>", "</x>", "<script></script ", "<td rowspan=9>a<tr>", "<table><tr><td>x", "<ul><li>x"])
def test_hostile_pages_take_linear_time(piece):
    def seconds(n):
        began = time.process_time()
        html_text.page_text("<a " + piece * n + '>">')
        return time.process_time() - began

    seconds(100)
    assert seconds(8000) < 12 * seconds(2000) + 0.5


VOIDS = ["br"]
NAMES = ["p", "div", "b", "i", "ul", "section"]


def trees(depth):
    """Trees of elements as (tag, hidden, children) and words."""
    leaf = st.sampled_from(["one", " two ", "a&lt;b", "three\nfour", ("br", False, [])])
    return leaf if not depth else st.one_of(leaf, st.tuples(st.sampled_from(NAMES), st.booleans(), st.lists(trees(depth - 1), max_size=4)))


def written(x):
    if isinstance(x, str):
        return x
    tag, hidden, inner = x
    return f"<{tag}>" if tag in VOIDS else f"<{tag}{' hidden' if hidden else ''}>{''.join(map(written, inner))}</{tag}>"


def shown(x):
    """The words that such a tree shows, with breaks: 1 within a block's run of lines, 2 around a spaced block."""
    if isinstance(x, str):
        return [x.replace("&lt;", "<")]
    tag, hidden, inner = x
    if hidden:
        return []
    own = [y for c in inner for y in shown(c)]
    if tag == "br":
        return [1]
    return own if tag in ("b", "i") else [2, *own, 2] if tag in ("p", "ul") else [1, *own, 1]


def model_text(forest):
    out, text, gap = "", "", 0
    for x in [y for c in forest for y in shown(c)] + [1]:
        if isinstance(x, str):
            text += x
            continue
        line = re.sub(r"\s+", " ", text).strip(" ")
        if line:
            out += ("\n\n" if gap > 1 else "\n") * bool(out) + line
            gap = 0
        text, gap = "", max(gap, x)
    return out


def no_blocks_in_p(x, inside=False):
    """HTML ends an open p at a block, and a list within a list has no blank line around it: such trees are left out."""
    if isinstance(x, str):
        return True
    tag, _, inner = x
    if inside and tag in ("p", "div", "ul", "section"):
        return False
    return all(no_blocks_in_p(c, inside or tag in ("p", "ul")) for c in inner)


@settings(max_examples=300, deadline=None)
@given(st.lists(trees(3), max_size=5))
def test_html_against_a_plain_renderer(forest):
    forest = [x for x in forest if no_blocks_in_p(x)]
    assert html_text.page_text("".join(map(written, forest))) == model_text(forest)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<ul>", "<li>", "</ul>", "<pre>", "</pre>", "<blockquote>", "</blockquote>", "<dd>", "<b", "'", ">", "x", " y ", "&lt;", "<br/>", "<script>", "</div>", "<td/>", "</td>", "<!--"]), max_size=25).map("".join))
def test_html_never_fails(html):
    assert isinstance(html_text.page_text(html), str)


# 9


def quality_model(text):
    text = text or ""
    w = spaced(text, fold=False)
    lines = [x for x in text.split("\n") if spaced(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, big):
    rows, df = big
    more = [(5000, "a b c d e f g h i " * 9), (5001, "same line here\n" * 30), (5002, "é# " * 30), (5003, "a " * 8), (5004, "a " * 9)]
    got = quality.ledger(df.union(documents(spark, more)))
    measured = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("b"))
    want = []
    for i, t in rows + more:
        m = quality_model(t)
        want.append((i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert as_rows(measured) == sorted(want, key=repr)
    kept = got.where(quality.passes()).count()
    ab = {r.rule: r for r in quality.ablation(got).collect()}
    assert all(r.n_kept == kept for r in ab.values())
    bits = [r.failures for r in got.collect()]
    for i, rule in enumerate(quality.RULES):
        if rule in ab:
            assert (ab[rule].n_failed, ab[rule].n_failed_alone) == (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits))
    assert quality.ledger(documents(spark, [])).count() == 0
    assert not any("Arrow" in x or "Python" in x for x in [got._jdf.queryExecution().toString()])


def test_windows_of_equal_hash(spark, monkeypatch):
    """Hashes of two values: windows are told apart by their words."""
    monkeypatch.setattr(quality, "hash64", lambda w: F.pmod(F.xxhash64(w), F.lit(2)))
    monkeypatch.setattr(quality, "hash32", lambda w: F.lit(0))
    rows = [*corpus(6, 30), (70, "a b c d e f g h i " * 9), (71, " ".join(map(str, range(60)))), (72, " ".join([*"abcdefgh", *map(str, range(30)), *"abcdefgh"]))]
    got = quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_repeat_words")
    assert as_rows(got) == sorted(((i, quality_model(t)[4]) for i, t in rows), key=repr)


def test_helper_names_of_quality(spark):
    names = ["t", "w", "n", "l", "h", "s", "k", "e", "f", "p", "doc", "_t", "_w", "n_chars", "n_words", "failures", "bits", "a b", "x.y"]
    rows = [(1, "one two three four " * 10, *range(len(names))), (2, None, *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = quality.keep(spark.createDataFrame([(3, " ".join(f"word{i}" for i in range(50)), *range(len(names)))], df.schema).union(df))
    assert kept.columns == df.columns and [tuple(r)[2:] for r in kept.collect()] == [tuple(range(len(names)))]
    assert quality.ledger(df.drop("a b", "x.y")).select("t", "w", "h", "bits").distinct().count() == 1


# 10


def leak_model(rows, bench):
    windows = defaultdict(set)
    for item, t in bench:
        w = alnum(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(str(item) if item is not None else "")
    out = []
    for i, t in rows:
        w = alnum(t)
        hit, ids = set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if (x := tuple(w[j : j + k])) in windows:
                    hit |= set(range(j, j + k))
                    ids |= windows[x]
        out.append((i, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("blocks", [10**9, 60])
def test_decontamination(spark, big, monkeypatch, blocks):
    rows, df = big
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(40)]
    bench = [(1, " ".join(passage)), (2, "omega Omega, the"), (3, None), (4, "—"), (10, " ".join(passage[5:30])), (None, "délta délta"), (1, "x1 the x1")]
    more = [(6000 + k, " ".join(["w"] * rng.randrange(400) + passage[a : a + n] + ["z"] * rng.randrange(30))) for k, (a, n) in enumerate([(0, 40), (3, 13), (5, 12), (20, 20), (0, 25)])]
    more += [(6100, " ".join(passage) + " " + " ".join(passage)), (6101, (" ".join(passage[:20]) + ". ") * 3)]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(decontam, "SHARD_WORDS", 500)
    found = decontam.find(df.union(documents(spark, more)), spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit("x"))).withColumn("n_hit", decontam.n_hit())
    got = found.select("doc_id", "n_words", "n_hit", "hit_items", decontam.contaminated())
    assert as_rows(got) == sorted(leak_model(rows + more, bench), key=repr)
    cleaned = {r.doc_id: r.text for r in decontam.clean(found.drop("n_hit")).where("doc_id >= 6000").collect()}
    for k, t in more:
        model = leak_model([(k, t)], bench)[0]
        assert (k in cleaned) == (not model[4])
        if k in cleaned:
            assert len(alnum(cleaned[k])) == model[1] - model[2]
    none = decontam.find(df, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("size(hit_spans) > 0").count() == 0
    assert decontam.find(documents(spark, []), spark.createDataFrame(bench, "item_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index(symbols, phrase):
    symbols = [*symbols, 1, 2, 3, 4]  # phrases are asked for only if the shard has all their words
    index = decontam.FMIndex(np.array([*symbols, 0], np.int32))
    lo, hi = index.search(np.array([phrase], np.int64))
    found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    assert found == [i for i in range(len(symbols)) if symbols[i : i + len(phrase)] == phrase]


def test_suffix_array_of_long_repeats():
    s = np.array([1] * 5000 + [2, 1] * 500 + [0], np.int32)
    sa = decontam.suffix_array(s)
    assert sorted(sa.tolist()) == list(range(len(s)))
    big = np.array(s, ">i4").tobytes()
    assert all(big[4 * a :] < big[4 * b :] for a, b in zip(sa[:-1:97], sa[1::97], strict=False))
