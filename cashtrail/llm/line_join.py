"""Line dedup by a segment-partition edit join, in DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .tables import Scratch, as_text, low_labels

EDITS = 2                   # lines this many edits apart, or fewer, are one
LEAST_CHARS = 24            # shorter lines are not looked at
STAR_ROUNDS = 2
BROADCAST_ROWS = 500_000    # numbers of eight bytes that every executor may hold
GRAIN = 4                   # lengths are told apart in steps of this many characters where segments are cut; divides LEAST_CHARS
NATIVE_CHARS = 1_000        # up to this length Spark's own distance is faster than the band, whose steps it takes once a character of both
LETTERS = "aeiounrtshdl"    # counted per line to tell pairs apart before they are formed; any characters would do
BLOCKS = 8                  # of a line's signatures, which leave two of them out
SAMPLED = 12                # columns looked at before the whole band is run


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line_no, lid, line) of the lines long enough; ``key`` tells rows of one doc_id apart by text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("__text"))
    rows = rows.select("doc_id", F.xxhash64("__text").alias("key"), F.posexplode(F.split("__text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim("line")).filter(F.length("line") >= LEAST_CHARS)
    return rows.select("doc_id", "key", "line_no", F.xxhash64("line").alias("lid"), "line")


def segment_keys(size: str) -> list[str]:
    """Keys of a line of n characters among the lines whose length is ``size`` or a little more.

    The first, second and last ``size`` div 3 characters, and the second ones a place later. Two edits leave one of these three
    untouched. The first stands at the start of both lines then, the last at their end. With one edit in each of those, the second
    is moved by the first edit alone: not at all, or by one place seen from one of the two lines.
    """
    width = f"cast({size} div {EDITS + 1} as int)"
    starts = ((0, "1"), (1, f"{width} + 1"), (1, f"{width} + 2"), (2, f"n - {width} + 1"))
    return [f"xxhash64({size}, {i}, substring(line, {start}, {width}))" for i, start in starts]


def _keyed(lines: DataFrame) -> DataFrame:
    """(k, lid): segment keys of every line, by its length in steps of GRAIN and, if a shorter partner may lie there, by the step before."""
    size = f"(n - n % {GRAIN})"
    own, lower = segment_keys(size), segment_keys(f"({size} - {GRAIN})")
    keys = f"if(n % {GRAIN} < {EDITS} and {size} > {LEAST_CHARS}, array({', '.join(own + lower)}), array({', '.join(own)}))"
    return lines.select("lid", "line", F.length("line").alias("n")).select(F.explode(F.expr(keys)).alias("k"), "lid")


def within_edits(a: str, b: str, edits: int = EDITS) -> Column:
    """Whether two strings of ``LEAST_CHARS`` or more are at most ``edits`` apart: by Spark's bounded distance up to NATIVE_CHARS, beyond
    by a bit-parallel band along the diagonal, whose work does not grow with the square of the length.

    The band of 2 * edits + 1 cells moves down one row per column; vertical differences are two bit sets, a column is a few bit operations.
    The distance is followed down the band's lower rim and, once that meets the last row, along this row.
    """
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    first = ((1 << (edits + 1)) - 1) << edits
    same = " | ".join(f"if(get(q.p, cast(j - {edits + 1} + {i} as int)) = c, {1 << i}L, 0L)" for i in range(width))
    window = f"transform(array(get(q.t, cast(j - 1 as int))), c -> {same})[0]"
    diagonal = f"transform(array({window}), x -> (((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & {mask}L))[0]"
    up, down = f"((s.vn | ~(d0 | s.vp)) & {mask}L)", "(d0 & s.vp)"
    rim = f"if((d0 & {top}L) = 0L, 1, 0)"
    row = f"shiftleft(1L, cast(size(q.p) - j + {edits} as int))"
    along = f"(if(({up} & {row}) != 0L, 1, 0) - if(({down} & {row}) != 0L, 1, 0))"
    after = (f"named_struct('vp', ({down} | ~(shiftrightunsigned(d0, 1) | {up})) & {mask}L, 'vn', shiftrightunsigned(d0, 1) & {up}, "
             f"'dist', s.dist + if(j <= size(q.p) - {edits}, {rim}, {along}))")
    step = f"transform(array({diagonal}), d0 -> {after})[0]"
    run = f"aggregate(sequence(1, size(q.t)), named_struct('vp', {first}L, 'vn', 0L, 'dist', {edits}), (s, j) -> {step}, s -> s.dist)"
    # a character without an equal one in its column's band costs an edit: a few columns tell most pairs apart
    near = f"substring({a}, greatest(1, j - {edits}), j + {edits + 1} - greatest(1, j - {edits}))"
    sample = f"size(filter(sequence(1, length({b}), greatest(1, length({b}) div {SAMPLED})), j -> instr({near}, substring({b}, j, 1)) = 0)) <= {edits}"
    # q holds the characters of both; binding it once keeps them from being split again in every step
    run = f"transform(array(struct(split({a}, '') as p, split({b}, '') as t)), q -> {run})[0]"
    exact = f"if(length({a}) <= {NATIVE_CHARS}, levenshtein({a}, {b}, {edits}) >= 0, {run} <= {edits})"
    return F.expr(f"if(abs(length({a}) - length({b})) <= {edits}, if({sample}, {exact}, false), false)")


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) among candidate pairs of line ids."""
    both = (pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a")
            .join(texts.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b"))
    return scratch.keep(both.filter(within_edits("x", "y")).select("a", "b"), f"{name}-links")


def _signatures(texts: DataFrame) -> DataFrame:
    """(k, lid, own): hashes of a line without two of its BLOCKS even blocks, own ones and those of shorter or equal partners.

    Two edits touch at most two blocks of the shorter line; the blocks before the first stand where they stood, those after the second
    are moved by the difference in length, those between by what the first edit moved them: by one or not at all, seen from the
    longer line or, of lines of one length, from one of the two. Edits in one block leave it and a neighbour out, with nothing between.
    So lines two edits apart share a signature, and lines that share one agree everywhere but in two blocks.
    """
    wide = texts.select("lid", F.length("line").alias("n"), F.encode("line", "UTF-32").alias("u"))
    rows = wide.select("lid", "n", "u", F.explode(F.array(*[F.lit(d) for d in range(EDITS + 1)])).alias("d")).withColumn("size", F.col("n") - F.col("d"))
    full = f"({BLOCKS} - size % {BLOCKS})"
    cut = (f"xxhash64(i, substring(u, cast(4 * (i * (size div {BLOCKS}) + greatest(0, i - {full}) + m) + 1 as int), "
           f"cast(4 * ((size div {BLOCKS}) + if(i >= {full}, 1, 0)) as int)))")
    # for every move m from 0 to EDITS the exclusive-or of the first j block hashes, j = 0..BLOCKS
    sums = (f"transform(sequence(0, {EDITS}), m -> aggregate(sequence(0, {BLOCKS - 1}), array(0L), (a, i) -> concat(a, array(a[size(a) - 1] ^ {cut}))))")
    moves = {0: (0, 1), 1: (0, 1), 2: (1,)}
    picks = [F.struct(F.lit(d).alias("pd"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(m).alias("m"))
             for d, ms in moves.items() for x in range(BLOCKS) for y in range(x + 1, BLOCKS) for m in (ms if y > x + 1 else (0,))]
    rows = rows.select("lid", "d", "size", F.expr(sums.replace("size(a)", "cardinality(a)")).alias("p"))
    chosen = F.explode(F.filter(F.array(*picks), lambda q: q["pd"] == F.col("d"))).alias("q")
    rows = rows.select("lid", "d", "size", "p", chosen).select("lid", "d", "size", "p", "q.x", "q.y", "q.m")
    key = f"xxhash64(size, x, y, p[0][x], p[m][y] ^ p[m][x + 1], p[d][{BLOCKS}] ^ p[d][y + 1])"
    return rows.select(F.expr(key).alias("k"), "lid", ((F.col("d") == 0) & (F.col("m") == 0)).alias("own"))


def _shared(keyed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of the keys under which two lines meet, one of them by its own entry where these are marked."""
    indexed = F.max("own") if "own" in keyed.columns else F.lit(True)
    shared = (keyed.groupBy("k").agg(F.min("lid").alias("low"), F.max("lid").alias("high"), indexed.alias("indexed"))
              .filter("low <> high and indexed").select("k"))
    return keyed.join(_few(scratch.keep(shared, f"{name}-keys")), "k").distinct()


def _few(table: DataFrame) -> DataFrame:
    """A written table of numbers, sent to every executor while it has at most BROADCAST_ROWS rows; beyond that both sides of a join are dealt out."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("shuffle_hash")


def _letters(texts: DataFrame) -> DataFrame:
    """(lid, f): how often each of LETTERS stands in a line. An edit changes these counts by two in all at most."""
    count = lambda c: F.octet_length("line") - F.octet_length(F.replace("line", F.lit(c), F.lit("")))
    return texts.select("lid", F.array(*[count(c) for c in LETTERS]).alias("f"))


def line_links(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) of line ids whose groups are those of all pairs within EDITS.

    Only lines that meet another one under a segment go on. Where many lines share a segment and differ elsewhere, pairs by
    segment would grow with the square of their number, so the lines that are left meet again under signatures, which only lines
    alike but for two blocks share. Star rounds tie the lines of a signature to one of its owners and fold groups of near
    copies; then each signature pairs the lines outside its largest group with the others.
    """
    keyed = scratch.keep(_keyed(lines), "keyed")
    ids = scratch.keep(_shared(keyed, scratch, "segment").select(F.col("lid").alias("id")).distinct(), "ids")
    scratch.drop("keyed", "segment-keys")
    texts = lines.select("lid", "line").join(_few(ids), F.col("lid") == F.col("id")).groupBy("lid").agg(F.min("line").alias("line"))
    texts = scratch.keep(texts, "texts")
    signed = scratch.keep(_signatures(texts), "signed")
    rows = scratch.keep(_shared(signed, scratch, "signature"), "rows")
    scratch.drop("signed", "signature-keys")
    posts, links, tried = rows.withColumn("comp", F.col("lid")), None, None
    for turn in range(STAR_ROUNDS):
        lead = F.min_by(F.when(F.col("own"), F.col("lid")), F.when(F.col("own"), F.xxhash64(F.lit(turn), "lid")))
        heads = posts.groupBy("k").agg(lead.alias("a"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("k", "a")
        pairs = posts.join(heads, "k").filter("lid <> a").select(F.least("lid", "a").alias("a"), F.greatest("lid", "a").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        now = scratch.keep(pairs, f"tried{turn}")
        tried = now if tried is None else tried.union(now)
        found = _verified(now, texts, scratch, f"star{turn}")
        links = found if links is None else links.union(found)
        posts = scratch.keep(rows.join(low_labels(links).withColumnRenamed("node", "lid"), "lid", "left")
                             .withColumn("comp", F.coalesce("comp", "lid")), f"posts{turn}")
    counts = posts.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("k").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    left = scratch.keep(posts.join(main.select("k", "main"), "k").join(_letters(texts), "lid"), "left")
    ours = left.filter("comp <> main").select("k", *[F.col(c).alias(f"{c}2") for c in ("lid", "own", "comp", "f")])
    apart = f"aggregate(zip_with(f, f2, (x, y) -> abs(x - y)), 0, (a, x) -> a + x) <= {2 * EDITS}"
    met = left.join(ours, "k").filter(f"comp <> comp2 and (own or own2) and (comp = main or lid < lid2) and {apart}")
    pairs = met.select(F.least("lid", "lid2").alias("a"), F.greatest("lid", "lid2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    found = _verified(scratch.keep(pairs, "pairs"), texts, scratch, "rest")
    scratch.drop("rows", "left", *[f"posts{t}" for t in range(STAR_ROUNDS)])
    return links.union(found)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines that repeat an earlier one: (doc_id, key, removed), ``removed`` the line numbers of a document, ascending.

    Equal lines and lines within EDITS of each other, directly or through others, are one class; its first line by
    (doc_id, text hash, line number) stays.
    """
    scratch = Scratch(docs.sparkSession)
    lines = _lines(docs)
    seen = scratch.keep(lines.drop("line"), "seen")
    links = line_links(lines, scratch)
    groups = components(links.select(F.col("a").alias("src_account"), F.col("b").alias("dst_account"))).select(F.col("account_id").alias("lid"), F.col("component").alias("class"))
    classed = scratch.keep(seen.join(groups, "lid", "left").select("doc_id", "key", "line_no", F.coalesce("class", "lid").alias("class")), "classed")
    many = classed.groupBy("class").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("class")
    again = scratch.keep(classed.join(many, "class"), "again")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line_no")
    first = again.groupBy("class").agg(F.min(place).alias("first"))
    out = again.join(first, "class").filter(~place.eqNullSafe(F.col("first")))
    return scratch.keep(out.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("line_no")).alias("removed")), "removed")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines, all columns kept; ``text`` is what stays, with its line ends."""
    removed = repeated_lines(docs).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("removed").alias("__removed"))
    joined = docs.join(removed, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(as_text()) == F.col("__key")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__removed", i)), "\n")
    names = [c for c in docs.columns]
    return joined.select(*[F.when(F.col("__removed").isNotNull(), kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in names])


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): repeated lines of every document.

    Defined results: null text is one empty line; lines under LEAST_CHARS code points, blanks at the ends not counted, are
    never removed; repeated rows (same doc_id and text) lose the same lines; null doc_id comes last in order; an
    empty table gives an empty result; columns other than doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(as_text()).alias("__k"), F.size(F.split(as_text(), "\n")).cast("long").alias("n_lines"))
    removed = repeated_lines(docs).select(F.col("doc_id").alias("__id"), "key", "removed")
    joined = rows.join(removed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("key")), "left")
    none = F.array().cast("array<int>")
    return joined.select("doc_id", "n_lines", F.size(F.coalesce("removed", none)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"))
