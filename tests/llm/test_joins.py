"""N-gram join and line dedup against all pairs."""

import random
import re

import numpy as np
import pytest

from cashtrail.llm import line_join, ngram_join

WORD = re.compile("[^\x20\x09-\x0d]+")


def sets(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset([tuple(words)] if 0 < len(words) < 3 else [tuple(words[i:i + 3]) for i in range(len(words) - 2)])


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def expected_join(rows):
    own = [sets(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if own[i] and own[j] and 9 * max(len(own[i]), len(own[j])) <= 10 * min(len(own[i]), len(own[j]))
            and 100 * len(own[i] & own[j]) >= 90 * len(own[i] | own[j])]
    root, low = groups(len(rows), near), {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return sorted(((d, len(s), low.get(r) if s else d) for (d, _), s, r in zip(rows, own, root)), key=str)


def joined(df):
    return sorted((tuple(r) for r in ngram_join.ngram_join(df).collect()), key=str)


def test_join_of_the_whole_small_table(small):
    assert joined(small) == expected_join([(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()])


def test_join_of_odd_rows(odd):
    assert joined(odd) == expected_join([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


def test_join_of_nothing(empty):
    assert joined(empty) == []


def test_join_of_hot_groups(spark, monkeypatch):
    """A group of near copies larger than a list may be, shared passages, and borderline pairs."""
    monkeypatch.setattr(ngram_join, "LONG_LIST", 8)
    monkeypatch.setattr(ngram_join, "PER_PART", 7)
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(4000)
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(60)], []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = word()
        rows.append((i, " ".join(own)))
    for i in range(60, 100):
        rows.append((i, " ".join(passage + [word() for _ in range(rng.choice([1, 3, 6, 60]))])))
    got = joined(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == expected_join(rows)
    assert len({c for _, _, c in got}) < 90


def test_join_of_short_texts(spark):
    """Sizes on both sides of the one where lists change from pairs of grams to single ones."""
    rng, texts = random.Random(4), []
    for n in (8, 20, 34, 38, 42, 60, 75, 79, 80, 82, 86, 90, 120):
        base = [f"w{rng.randrange(60)}" for _ in range(n)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                kind = rng.randrange(3)
                if kind == 0:
                    own[rng.choice((0, -1, rng.randrange(len(own))))] = f"v{rng.randrange(9)}"
                else:
                    own = own + [f"x{rng.randrange(3)}"] if kind == 1 else own[1:]
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    docs, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), expected_join(rows)
    for paired in (ngram_join.PAIRED, 0):
        assert sorted((tuple(r) for r in ngram_join.ngram_join(docs, paired=paired).collect()), key=str) == want


def test_templates_form_no_pairs_by_the_square(spark, monkeypatch):
    """5,000 short texts of one template with a number each: what is verified does not exceed the rows."""
    formed, verify = [], ngram_join.Join.verify

    def counted(self, pairs):
        formed.append(pairs.count())
        return verify(self, pairs)

    monkeypatch.setattr(ngram_join.Join, "verify", counted)
    text = "dear customer your reference number is {} and it stays valid until further notice so please keep it at hand when you call {} us"
    docs = spark.createDataFrame([(i, text.format(i, i % 7)) for i in range(5000)], "doc_id long, text string").repartition(4)
    assert ngram_join.ngram_join(docs).select("component_id").distinct().count() == 5000
    assert sum(formed) <= 5000


def test_near_misses_are_not_paired(spark, monkeypatch):
    """Many sets a little under the threshold of one large group: next to no pair of them is verified."""
    verified = []
    old = ngram_join.Join.verify
    monkeypatch.setattr(ngram_join.Join, "verify", lambda self, pairs: (verified.append(pairs.count()), old(self, pairs))[1])
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join([*base[:i % 149], f"copy{i}", *base[i % 149 + 1:]]) for i in range(150)]
    for i in range(150):  # four words exchanged: up to 12 of 148 windows, Jaccard 0.85 and less to most others
        words = list(base)
        for k in range(4):
            words[(i + 37 * k) % 150] = f"miss{i}x{k}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == expected_join(rows)
    assert verified[-1] < 2 * len(rows)


def test_bitmaps_differ_in_no_more_bits_than_sets_in_grams():
    draw = np.random.default_rng(5)
    for _ in range(200):
        a, b = draw.integers(0, 1 << 63, draw.integers(1, 700), dtype=np.uint64), draw.integers(0, 1 << 63, draw.integers(0, 90), dtype=np.uint64)
        a, b = np.unique(a), np.unique(np.concatenate([a[:draw.integers(0, len(a) + 1)], b]))
        bits = (ngram_join._parity(a) ^ ngram_join._parity(b)).view(np.uint64)
        assert sum(int(x).bit_count() for x in bits) <= len(np.setxor1d(a, b))


def test_divide_skip_finds_the_sets_that_overlap_enough():
    rng = np.random.default_rng(3)
    query = np.unique(rng.integers(0, 2 ** 63, 200).astype(np.uint64))
    block = []
    for k in range(40):
        kept = rng.permutation(query)[: len(query) - k]
        block.append(np.unique(np.concatenate([kept, rng.integers(0, 2 ** 63, k // 2).astype(np.uint64)])))
    want = [i for i, s in enumerate(block) if 10 * len(np.intersect1d(query, s)) >= 9 * len(np.union1d(query, s))]
    assert sorted(ngram_join.divide_skip(query, block)) == want and 0 < len(want) < 40


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close(a, b):
    if abs(len(a) - len(b)) > 2:
        return False
    bag = {}
    for c in a:
        bag[c] = bag.get(c, 0) + 1
    for c in b:
        bag[c] = bag.get(c, 0) - 1
    return sum(map(abs, bag.values())) <= 4 and edits(a, b) <= 2


def expected_removed(rows):
    """Removed lines per (doc_id, text), the order of equal doc_ids left open (these tests have none that matter)."""
    places = [(d is None, d, t, i, line.strip(" ")) for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")) for i, line in enumerate((t or "").split("\n"))]
    places = [p for p in places if len(p[4]) >= line_join.LEAST_CHARS]
    lines = sorted({p[4] for p in places}, key=lambda x: (len(x), x))
    near = []
    for i, a in enumerate(lines):
        for j in range(i + 1, len(lines)):
            if len(lines[j]) - len(a) > 2:
                break
            if close(a, lines[j]):
                near.append((i, j))
    root, first, out = dict(zip(lines, groups(len(lines), near))), set(), {}
    for _, d, t, i, line in places:
        if root[line] in first:
            out.setdefault((d, t), []).append(i)
        first.add(root[line])
    return sorted(((d, len((t or "").split("\n")), out.get((d, t), [])) for d, t in rows), key=str), len(near)


def reported(df):
    return sorted(((r.doc_id, r.n_lines, r.removed) for r in line_join.line_report(df).collect() if r.n_removed == len(r.removed)), key=str)


def test_lines_of_the_whole_small_table(small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    assert reported(small) == expected_removed(rows)[0]


def test_edited_lines(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(26, 90))).strip() + "z" * 8 for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(3):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(line))
                what = rng.randrange(3)
                line[at:at + (what != 0)] = [] if what == 1 else [rng.choice("xyz\U0001f600")]
            lines.append("".join(line))
        rows.append((d, "\n".join(lines)))
    want, near = expected_removed(rows)
    assert near > 50
    assert reported(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_odd_and_no_lines(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert reported(odd) == expected_removed(rows)[0]
    assert reported(empty) == []
    kept = line_join.dedup_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


@pytest.mark.parametrize("seed", range(3))
def test_banded_distance(spark, seed):
    rng, rows = random.Random(seed), []
    for _ in range(120):
        a = [rng.choice("abéc") for _ in range(rng.randrange(24, 50))]
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            at, what = rng.randrange(len(b)), rng.randrange(3)
            b[at:at + (what != 0)] = [] if what == 1 else [rng.choice("abcd")]
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("near", line_join.within_edits("a", "b"))
    for r in df.collect():
        assert r.near == (edits(r.a, r.b) <= 2), r


def test_keys_of_lines_two_edits_apart(spark):
    rng, rows = random.Random(23), []
    for case in range(400):
        a = [rng.choice("abé漢") for _ in range(rng.randrange(24, 60))]
        b = list(a)
        for _ in range(2):
            # also at the cuts: an insertion behind the last character, at the first one, between segments
            what, at = rng.randrange(3), rng.choice([0, len(b) // 3, 2 * len(b) // 3, len(b) - 1, rng.randrange(len(b))])
            b[at:at + (what != 0)] = [] if what == 1 else [rng.choice("ab\U0001f600")]
            if what == 0 and rng.random() < 0.2:
                b.append(b.pop(at))
        a, b = "".join(a), "".join(b)
        if a != b and len(b) >= line_join.LEAST_CHARS and edits(a, b) <= 2:
            rows += [(2 * case, a), (2 * case + 1, b)]
    assert len(rows) > 500
    lines = spark.createDataFrame(rows, "lid long, line string")
    segments, signatures = {}, {}
    for r in line_join._keyed(lines).collect():
        segments.setdefault(r.lid, []).append(r.k)
    for r in line_join._signatures(lines).collect():
        signatures.setdefault(r.lid, []).append((r.k, r.own))
    for lid, _ in rows[::2]:
        assert set(segments[lid]) & set(segments[lid + 1])
        own = [{k for k, mine in signatures[x] if mine} for x in (lid, lid + 1)]
        every = [{k for k, _ in signatures[x]} for x in (lid, lid + 1)]
        assert own[0] & every[1] or own[1] & every[0]


def test_number_of_keys_of_a_line(spark):
    lines = spark.range(24, 224).selectExpr("id as lid", "substring(repeat('The quick brown fox. ', 12), 1, cast(id as int)) as line")
    # 12 and 224 a line when every length asked for its own segments and every move was made from both lines
    assert line_join._keyed(lines).count() <= 6 * 200
    assert line_join._signatures(lines).count() <= 126 * 200


def test_distance_of_long_and_wide_lines(spark):
    rng, rows = random.Random(4), []
    for n in (24, 300, line_join.NATIVE_CHARS - 1, line_join.NATIVE_CHARS, line_join.NATIVE_CHARS + 1):
        for k in range(4):
            a = [rng.choice("aé漢\U0001f600") for _ in range(n)]
            b = list(a)
            for at in rng.sample(range(n), k):
                b[at] = "z"
            rows.append(("".join(a), "".join(b), k <= 2))
            rows.append(("".join(a), "x" + "".join(b)[:-1] if k == 0 else "".join(b) + "yyy"[:k], k == 0 or 2 * k <= 2))
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = df.withColumn("there", line_join.within_edits("a", "b")).withColumn("back", line_join.within_edits("b", "a")).collect()
    assert [r.there for r in got] == [r.want for r in got] == [r.back for r in got]
