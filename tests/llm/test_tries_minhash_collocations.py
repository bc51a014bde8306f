import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kgspark.llm import collocations, minhash, prefixtrie

CONV = "conv_id long, turn long, role string, text string, p1 string, up long"


def trie(rows):
    """Plain trie of the contract."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = set()
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in under)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.add((min(members), len(path), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    rows = []
    for c in range(40):
        n = {3: 45, 8: 45, 23: 70}.get(c, c % 9 + 1)
        for t in range(n):
            same = c % 3 == 0 or t < c % 4
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if same else f"turn {t} of {c % 7} é", "x", 1))
    rows += [(41, None, None, None, "x", 1), (41, 1, "user", "a", "x", 1), (41, 1, "user", "a", "x", 1), (42, 0, "user", "", None, None), (None, 0, "user", "lost", None, None)]
    rows += [(1000 + c, 0, "user", "the very same", "x", 1) for c in range(1200)]
    return rows


@pytest.mark.parametrize("narrow", [0, 12, 256, 100_000])
def test_prefix_trie_equals_plain_trie(spark, narrow):
    rows = conversations()
    got = prefixtrie.prefix_trie(spark.createDataFrame(rows, CONV).repartition(5), narrow).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == trie(rows)


def test_prefix_trie_without_conversations(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], CONV)).count() == 0
    assert prefixtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a", None, None)], CONV)).count() == 0


def test_bands_hold_few_pieces():
    assert prefixtrie._bands({}, 4) == []
    # from the top 1, 2 and 3 conversations are alive: the first two blocks are one band
    assert prefixtrie._bands({3: 1, 2: 1, 1: 1, 0: 9}, 4) == [(2, 3, True), (1, 1, True), (0, 0, False)]


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows, percent=85):
    """(doc_id, n, component, kept) of each row by all pairs."""
    sets = [shingles(r[1]) for r in rows]
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and part[i] != part[j]:
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    out = []
    for i, r in enumerate(rows):
        ids = [x[0] for k, x in enumerate(rows) if part[k] == part[i] and x[0] is not None] if sets[i] else [r[0]]
        of = min((x for x in ids if x is not None), default=None)
        out.append((r[0], len(sets[i]), of, r[0] == of))
    return sorted(out, key=str)


DOC = "doc_id long, text string, row string, sig long, lang string"


def near_copies():
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(60):  # copies with one run of new words each: linked with the original, not always with each other
        words = list(base)
        words[3 * k : 3 * k + 1 + k % 14] = [f"x{k}a{i}" for i in range(1 + k % 14)]
        rows.append((500 - k, " ".join(words)))
    rows.append((7, " ".join(base).upper()))
    for k in range(1, 90, 4):  # chain of shifted windows, similarities on both sides of the threshold
        rows.append((900 + k, " ".join(f"c{i}" for i in range(k, k + 60))))
    rows += [(2000, "a b c"), (2001, "A  b\tc"), (2002, "a b"), (2003, ""), (2004, None), (2005, " \n"), (None, "a b c"), (None, "alone here"), (2006, "twice said"), (2006, "twice said")]
    rows.append((2010, " ".join(f"long{i}" for i in range(30_000))))
    rows.append((2011, " ".join(f"long{i}" for i in range(29_000))))
    return [(*r, "x", 1, "en") for r in rows]


@pytest.mark.parametrize("tile_rows", [4, 128])
def test_minhash_equals_all_pairs(spark, tile_rows):
    rows = near_copies()
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC).repartition(3), tile_rows=tile_rows)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == components(rows)


def test_minhash_of_no_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_blocks_find_what_stars_miss(spark):
    # the least row is linked with nobody, the others with their neighbours
    rows = [(k, " ".join(f"c{i}" for i in range(5 * k, 5 * k + 100)), "x", 1, "en") for k in range(12)] + [(100 + k, " ".join(f"c{i}" for i in range(5 * k + 1, 5 * k + 101)), "x", 1, "en") for k in range(12)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC))
    assert sorted((tuple(r) for r in got.collect()), key=str) == components(rows)


def test_estimate_corrects_chance():
    import numpy as np

    rng = np.random.default_rng(1)
    by = minhash.factors(320, 1)
    for bits in (1, 2, 4, 8):
        errors = []
        for shared in (0, 300, 600, 900):
            h = rng.integers(0, 1 << 63, 2000 - shared, dtype=np.uint64)
            x, y = h[:1000], np.concatenate([h[:shared], h[1000:]])
            a, b = (np.frombuffer(minhash.planes(minhash._mixed(minhash.minima(s, by)), bits), np.uint8) for s in (x, y))
            errors.append(minhash.estimate(minhash.differing(a, b, bits), 320, bits) - shared / (2000 - shared))
        assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / 4) < 0.1


def phrases(rows, least, cover, top):
    words, out = defaultdict(Counter), []
    for text, lang in rows:
        t = (text or "").translate({c: c + 32 for c in range(65, 91)} | dict.fromkeys(map(ord, ".,;:!?\n\x0b\x0c\r"), "\n"))
        for piece in t.split("\n"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            for m in (1, 2, 3):
                words[lang or "und"].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    for lang, f in words.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                longer = [c for q, c in f.items() if len(p) == 2 and len(q) == 3 and c >= least and p in (q[:2], q[1:])]
                if not any(100 * c >= cover * a for c in longer):
                    found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus():
    rows = [(f"The red fox, the RED\tfox! the red fox jumps over {i % 7} dogs; é ü\n. a a a a a", ["en", "fr", None, "und"][i % 4]) for i in range(60)]
    rows += [("hot " + " hot ".join(f"w{i % 40}" for i in range(400)), "en")] * 3 + [(None, "en"), ("", None), (" .,\r\x0b\x0c", "de"), ("und alone", "x y")]
    return rows


@pytest.mark.parametrize(("per_lang", "chunk"), [(2000, 1 << 25), (5, 2000)])
def test_collocations_equal_plain_counts(spark, per_lang, chunk):
    rows = corpus()
    docs = spark.createDataFrame([(t, x, 1, "p") for t, x in rows], "text string, lang string, c long, part string").repartition(3)
    got = collocations.collocations(docs, per_lang=per_lang, chunk_bytes=chunk)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == phrases(rows, 10, 50, per_lang)


def test_filters_only_save_work(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = collocations.collocations(docs, filter_bits=1 << 15, least=3, cover_percent=80)
    assert sorted(tuple(r) for r in got.collect()) == phrases(rows, 3, 80, 2000)


def test_collocations_of_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_large_counts_stay_exact(spark):
    a, left, right = 3_000_000_007, 3_000_000_019, 3_000_000_033
    got = spark.range(1).select(F.expr(f"cast(1000000 as decimal(38,0)) * cast({a} as decimal(38,0)) * cast({a} as decimal(38,0)) div (cast({left} as decimal(38,0)) * cast({right} as decimal(38,0)))").alias("s")).first().s
    assert got == 1_000_000 * a * a // (left * right)
