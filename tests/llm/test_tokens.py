"""Token operators and whitening against plain versions of their contracts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from cashtrail.llm import packing, token_align, vocab, whitening
from cashtrail.llm.queries import queries, table

tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
A_PATH, B_PATH = vocab.vocabulary(vocab.BYTE_FILE), vocab.vocabulary(vocab.PIECE_FILE)
LETTERS = list("ab  \n\t\r'’ste1２é́ ﷺ中文ЖḀ😀​ 　\x00\x1c\x85<s>|Ԁꟑ") + ["<|endoftext|>", "    ", "ation", "\n\n", "=====" * 40]
SPELLED = [" the cat", "a▁b", "<unk>", "x" * 5000, "=" * 700, "ab " * 3000, " lead and trail ", "\n\nlines\n \n", "naïve café — 東京タワー", "<|endoftext|>", "ꟑ new letter"]


def random_texts(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 40))) for _ in range(n)] + SPELLED


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_units_give_the_ids_of_whole_texts(small):
    texts = random_texts(4000) + [r.text for r in small.collect() if r.text]
    plain, marked = tokenizers.Tokenizer.from_file(A_PATH), tokenizers.Tokenizer.from_file(A_PATH)
    plain.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a, m, b = vocab.ByteTokens(A_PATH, True), vocab.ByteTokens(A_PATH, False), vocab.PieceTokens(B_PATH)
    assert b.apart
    for t in texts:
        units = vocab.units_of(t)
        assert ids(a.ids(t)) == plain.encode(t, add_special_tokens=False).ids, t
        found, spells = a.spaced(t, units)
        assert ids(found) == plain.encode(" " + t, add_special_tokens=False).ids and spells, t
        assert ids(m.ids(t)) == marked.encode(t, add_special_tokens=False).ids, t
        found, spells = b.spaced(t, units)
        assert spells == ("▁" not in t) and (not spells or ids(found) == pieces.encode(t)), t


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(vocab, "MOST_UNITS", 5)
    a = vocab.ByteTokens(A_PATH, True)
    words = [f"w{i} some text" for i in range(50)]
    assert [ids(a.ids(w)) for w in words] == [ids(vocab.ByteTokens(A_PATH, True).ids(w)) for w in words] and len(a.known) + len(a.known.old) <= 5


# ---- alignment ----------------------------------------------------------------------------------------------------

def brute_groups(text, plain, pieces, shown):
    """Groups of (A ids, B ids) of one text, straight from the contract."""
    if not text:
        return []
    spaced = (" " + text).encode()
    a, b = plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    sides = []
    for found, spell in ((a, lambda i: bytes(shown[c] for c in plain.id_to_token(i)) if i < 50256 else b"<|endoftext|>"),
                         (b, lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode())):
        spelled = [spell(i) for i in found]
        if b"".join(spelled) != spaced:
            return []
        sides.append(dict(zip(np.cumsum([len(s) for s in spelled]).tolist(), range(len(spelled)))))
    groups, at = [], (0, 0)
    for end in sorted(set(sides[0]) & set(sides[1])):
        now = sides[0][end] + 1, sides[1][end] + 1
        groups.append((a[at[0]:now[0]], b[at[1]:now[1]]))
        at = now
    return groups


def brute_alignment(texts):
    plain, pieces = tokenizers.Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    plain.encode_special_tokens = True
    whole = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in whole} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in whole)}
    grouped = [brute_groups(t, plain, pieces, shown) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in grouped]
    docs, best = Counter(p for x in links for p in x), defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = []
    for g, x in zip(grouped, links):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(x.values()), sum(n for p, n in x.items() if docs[p] == best[p[0]]),
                    sum(n * docs[p] for p, n in x.items()), hashlib.sha256(line.encode()).hexdigest() if g else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [token_align.FREQUENT, 40, 0])
def test_alignment_against_the_contract(spark, monkeypatch, frequent):
    texts = random_texts(250) + [None, "", "same text twice", "same text twice"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, pairs int, n_a int").repartition(5)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_align.token_alignment(docs, most_frequent=frequent).collect()}
    want = brute_alignment(texts)
    for i, t in enumerate(texts):
        assert got[i] == want[i], repr(t)


def test_alignment_of_documents(spark, small):
    rows = small.filter("length(text) < 3000").select("doc_id", "text")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_align.token_alignment(rows).collect()}
    texts = rows.collect()
    assert got == dict(zip((r.doc_id for r in texts), brute_alignment([r.text for r in texts])))


def test_large_groups_are_folded(monkeypatch):
    monkeypatch.setattr(token_align, "SMALL_GROUP", 1)
    aligner = token_align.Aligner(A_PATH, B_PATH)
    texts = ["=" * 301 + "—東京" * 5, "naïve — 東京タワー" * 3]
    _, hashes, edges, keys, times = aligner.block([aligner.tokens(t) for t in texts])
    monkeypatch.setattr(token_align, "SMALL_GROUP", 1 << 30)
    again = aligner.block([aligner.tokens(t) for t in texts])
    assert hashes == again[1] and all((x == y).all() for x, y in zip((edges, keys, times), again[2:])) and times.max() > 1


def test_gallop_finds_what_an_intersection_finds():
    rng = np.random.default_rng(5)
    a_counts, b_counts, a, b, top = [], [], [], [], 0
    for n, m in ((1, 1), (1, 5000), (5000, 1), (700, 900), (64, 64), (0, 0), (3, 2)):
        span = 20_000
        x, y = (np.sort(rng.choice(span, k, replace=False)) + 1 if k else np.zeros(0, int) for k in (n, m))
        if n:
            x[-1] = y[-1] = span + 1
        a += (x + top).tolist()
        b += (y + top).tolist()
        a_counts.append(n)
        b_counts.append(m)
        top += span + 1
    at_a, at_b = token_align.common_ends(np.array(a), np.array(b), np.array(a_counts), np.array(b_counts))
    want = np.intersect1d(a, b)
    assert np.array_equal(np.array(a)[at_a], want) and np.array_equal(np.array(b)[at_b], want)


# ---- packing ------------------------------------------------------------------------------------------------------

def check_packing(rows, texts, size=packing.SIZE):
    tokenizer = tokenizers.Tokenizer.from_file(A_PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        found = np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]]
        assert sum(p.length for p in parts) == len(found) and (len(parts) == 1 if len(found) <= size else all(p.length == size for p in parts[1:]))
        assert [p.ids_crc32 for p in parts] == [zlib.crc32(found[p.start:p.start + p.length].tobytes()) for p in parts]
    for places in by_sequence.values():
        places.sort()
        assert [p for p, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= size
    return len(by_sequence)


def test_packing_of_odd_texts(spark):
    texts = random_texts(60) + [None, "", "word " * 9000, "x " * 2046, "x " * 2047 + "x", "<|endoftext|> a"] * 3
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(7)
    check_packing(packing.pack(docs).collect(), texts)
    check_packing(packing.pack(docs, size=64).collect(), texts, 64)


def test_packing_is_near_the_least_number(spark, small):
    texts = [r.text for r in small.orderBy("doc_id").collect()]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert check_packing(rows, texts) <= -(-sum(r.length for r in rows) // packing.SIZE) * 1.02 + 1


def test_best_fit_by_groups_is_best_fit_by_pieces():
    rng = np.random.default_rng(2)
    for size, n in ((12, 40), (30, 200), (7, 90)):
        lengths = sorted(rng.integers(1, size + 1, n).tolist(), reverse=True)
        bins = []
        for x in lengths:
            fits = [b for b in bins if b >= x]
            if fits:
                bins.remove(min(fits))
                bins.append(min(fits) - x)
            else:
                bins.append(size - x)
        groups = packing.best_fit(np.bincount(lengths, minlength=size + 1), size)
        rooms = sorted(size - sum(a * k for a, k in g.holds) for g in groups for _ in range(g.count))
        assert rooms == sorted(bins)


def test_patterns_fill_and_the_fit_takes_them():
    size = 48
    found = packing.patterns(size, 4, 10**6)
    want = {c for k in (2, 3, 4) for c in compositions(size, k)}
    assert {tuple(int(x) for x in row if x) for row in found} == want and len(found) == len(want)
    histogram = np.zeros(size + 1, np.int64)
    for row, n in (((30, 18), 500), ((20, 16, 12), 300), ((40, 4, 2, 2), 200)):
        for x in row:
            histogram[x] += n
    groups = packing.plan(histogram)
    assert sum(g.count for g in groups) == 1000 and sum(g.count for g in groups if sum(k for _, k in g.holds) <= 4) >= 900


def compositions(total, parts, most=None):
    most = most or total
    if parts == 1:
        return [(total,)] if 1 <= total <= most else []
    return [(x, *rest) for x in range(min(most, total - parts + 1), 0, -1) for rest in compositions(total - x, parts - 1, x)]


# ---- whitening ----------------------------------------------------------------------------------------------------

def brute_whitening(rows, components=16):
    keep = [(k, np.floor(np.asarray(v, float) * 64).astype(object).astype(int) + 1_000_000) for k, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    fit = np.array(sorted({tuple(x.tolist()) for _, x in keep}), object)
    n, sums = len(fit), fit.sum(0)
    moved = (n * fit - sums).astype(float) / n
    v = moved.T @ moved / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    out = {}
    for k, x in keep:
        d = n * x.astype(object) - sums
        out[k] = int((d * d).sum()), (d.astype(float) / n) @ u[:, order] / np.sqrt(e[order])
    return n, e[order] / e.sum(), out


VECTORS = "vec_id long, embedding array<float>, label int, n int, component string"


def vector_rows(n=700, size=20, wide=False):
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(n, size)) * np.linspace(1, 3, size)).astype(np.float32)
    if wide:
        v[5, 3], v[6, 4] = 3e4, -2e5
    rows = [(i, x.tolist(), None, 1, "c") for i, x in enumerate(v)] + [(n + i, v[0].tolist(), 1, 1, "c") for i in range(n // 2)]
    return rows + [(5000, None, 1, 1, "c"), (5001, [None] * size, 1, 1, "c"), (5002, [float("nan")] + [0.0] * (size - 1), 1, 1, "c"), (5003, [float("-inf")] + [0.0] * (size - 1), 1, 1, "c")]


@pytest.mark.parametrize("wide", [False, True])
def test_whitening_against_a_plain_version(spark, wide):
    rows = vector_rows(wide=wide)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(6)).collect()
    n, shares, want = brute_whitening([r[:2] for r in rows])
    assert {r.n for r in got} == {n} and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-4
    assert sorted({(r.component, r.explained) for r in got}) == [(i + 1, pytest.approx(s, rel=1e-9)) for i, s in enumerate(shares)]
    by = defaultdict(dict)
    for r in got:
        assert int(r.deviation) == want[r.vec_id][0]
        by[r.vec_id][r.component] = r.whitened
    assert set(by) == set(want) and all(len(x) == 16 for x in by.values())
    signs = np.sign([by[0][c + 1] * want[0][1][c] for c in range(16)])
    assert np.allclose([[by[k][c + 1] for c in range(16)] for k in want], [want[k][1] * signs for k in want], rtol=1e-6, atol=1e-6)


def test_cross_products_are_exact():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 1 << 40, (150, 4)).astype(np.uint64)
    y[:, 2] = 7
    bits = np.array([40, 40, 3, 40])
    total = {}
    whitening.cross_products(y, bits, np.concatenate([np.arange(b) for b in bits]), np.repeat(np.arange(4), bits), total)
    whole = y.astype(object)
    assert all(total[i, j] == int((whole[:, i] * whole[:, j]).sum()) for i in range(4) for j in range(i, 4)) and all(total[i, -1] == int(whole[:, i].sum()) for i in range(4))


def test_whitening_of_few_and_equal_vectors(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS))
    assert make([]).count() == 0 and make([(1, None, 1, 1, "c")]).count() == 0
    assert make([(i, [0.5, 0.25], 1, 1, "c") for i in range(9)]).count() == 0
    got = make([(1, [0.0, 1.0], 1, 1, "c"), (2, [1.0, 1.0], 1, 1, "c"), (None, [0.0, 1.0], 1, 1, "c"), (4, [1.0], 1, 1, "c"), (5, [], 1, 1, "c")]).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in got) == [(0, 1, 2, 4096, 1.0, 1.0), (1, 1, 2, 4096, 1.0, 1.0), (2, 1, 2, 4096, 1.0, 1.0)]


def test_odd_and_empty_tables(spark, odd, empty):
    for name in ("op11_token_alignment", "op13_packing"):
        run = {"op11_token_alignment": token_align.token_alignment, "op13_packing": packing.pack}[name]
        assert run(empty).count() == 0
        got = run(odd)
        assert got.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert token_align.token_alignment(odd).count() == odd.count()


def test_queries_read_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    found = queries()
    assert found["op11_token_alignment"](spark, folder).count() == table(spark, folder, "documents").count()
    white = found["op12_whitening"](spark, folder)
    assert isinstance(white.schema["deviation"].dataType, T.LongType) and white.select("vec_id").distinct().count() == table(spark, folder, "embeddings").count()
    packed = found["op13_packing"](spark, folder)
    assert packed.select("doc_id").distinct().count() == table(spark, folder, "documents").select("doc_id").distinct().count()
