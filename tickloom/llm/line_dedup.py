"""Line dedup by a deletion-neighbourhood join, in DataFrame operations alone.

A line goes if an earlier line equals it or is within its edit bound (characters inserted, deleted or replaced);
earlier is by doc_id, then by place in the text. Of lines the first occurrence stays. The bound is one edit for each
`min_chars` (20) characters of the shorter line, at most `edits`: 2 in the pipeline, 1 in op3_line_dedup, as its SQL has it. So
shorter lines have no near copies: in them one edit changes the meaning. Equal lines go if they have
`equal_chars` characters and are not blank: 1 in the pipeline, 20 in op3_line_dedup, as its SQL has it.

1. Equal lines are one line, known by 128 bits of hash and its first occurrence.
2. Lossless filter: of k + 1 disjoint parts of a line, k edits leave one as it is. A line of whose parts no other line has one
   has no neighbour; a line that shares only its first (last) part has its edit behind (before) it.
3. Of the others, where the bound is one edit, every variant without one character is a hashed key, and so is the line
   itself. Two lines that share a variant at one place, or of which one is a variant of the other, are neighbours; only the
   earliest line of a key is of interest, so no key makes pairs of all its lines. Variants differ from their
   line in one segment of `SEGMENT` characters, and what lies before and behind it is hashed once for each segment: a
   line costs as many rows as it has characters and never holds its variants together.
4. Where the bound is higher, variants lack whole segments: a key is a choice of at most k of `segments`, those that the edits touch, and of how each
   changes in length, with the hash of all that lies between them: a line has as many keys whatever its length, and neighbours
   share one. Lines that share a key are compared, in the chosen segments, while they are few. Of keys with many lines, where k segments are chosen
   each has one edit: rows stay only if in every segment another line of the key has a text one edit away, told as in 3. Of what
   is left the text of the segments is cut again in the same way, so that the next keys agree in more, until lines of a key differ in no more than twice as many
   characters as edits: there are only so many such lines, whatever the table's size.
5. What meets is verified by its edit distance.

Nulls: a null text is an empty line; a null doc_id comes after all others. Each row is a document of its own: rows are numbered
once, rows that share a doc_id (or have none) come in the order of their numbers, and lose their own lines alone. Tables
may be empty, and further columns may have any name. Texts that lose no line come back unchanged, byte for byte.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, combinations, count, product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import discard, maybe, maybe_in, positional, spread_join, staged, table, tidy

MIN_CHARS = 20
EDITS = 2
#: Characters of a segment in which variants lack one.
SEGMENT = 32
#: Segments above the edits, where variants lack whole segments.
SEGMENTS_MORE = 3
#: Lines of a key that are compared without another round.
FEW = 64
#: Places of a document's lines, and numbers of rows, in the order of lines.
_LINES, _ROWS = 1 << 28, 1 << 34


def numbered(docs: DataFrame) -> DataFrame:
    """row (numbers from 0 on without gaps), id, text (null: empty), and docs' columns as c0, c1 and so on; staged."""
    own, at = positional(docs)
    rows = staged(own.withColumn("unique", F.monotonically_increasing_id()), "numbered-rows")
    # Unique ids hold the writing task above 33 bits: one row for each task comes to the driver.
    parts, start, offsets = rows.groupBy(F.shiftright("unique", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect(), 0, []
    for p in parts:
        offsets.append((p.p, start))
        start += p.n
    of = F.broadcast(docs.sparkSession.createDataFrame(offsets, "part long, start long"))
    number = F.col("start") + F.col("unique").bitwiseAND(F.lit((1 << 33) - 1))
    joined = rows.join(of, F.shiftright("unique", 33) == F.col("part"))
    return joined.select(number.alias("row"), F.col(at["doc_id"]).cast("long").alias("id"), F.coalesce(at["text"], F.lit("")).alias("text"), *own.columns)


def _lines(docs: DataFrame, min_chars: int, equal_chars: int) -> DataFrame:
    """ord (place in the whole corpus, holding row and place), line, n (its length), h1, h2: the lines that count, of numbered docs."""
    rank = F.coalesce(F.col("id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")
    within = (F.col("row") * F.lit(_LINES)).cast("decimal(20,0)")
    base = ((rank * F.lit(_ROWS * _LINES).cast("decimal(19,0)")).cast("decimal(38,0)") + within).cast("decimal(38,0)")
    exploded = docs.select(base.alias("base"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).withColumn("n", F.length("line"))
    counting = exploded.where((F.col("n") >= min(min_chars, equal_chars)) & ((F.col("n") >= min_chars) | F.col("line").rlike(r"\S")))
    ord_ = (F.col("base") + F.col("place")).cast("decimal(38,0)")
    return counting.select(ord_.alias("ord"), "line", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _bound(length: str, min_chars: int, edits: int) -> str:
    return f"least({edits}, ({length}) div {min_chars})"


def _parts(min_chars: int, edits: int) -> Column:
    """kind, key of the parts of `line` one of which a neighbour shares; kind: 0 the first, 1 the last at one edit, 2 more edits.

    k + 1 parts of c characters: the first and the last lie at the line's ends. If edits touch both, parts between them are moved by less than k,
    so that each line has them at 0 to k - 1 from their place. c depends on the shorter line's length, in steps: neighbours that are
    a little longer mostly have the same, and otherwise have the parts for both.
    """
    parts = []
    for k in range(1, edits + 1):
        for more in range(k + 1):
            size, longer = f"(n - {more})", f"(n - {more - 1})"
            of = lambda x: f"(2 * ({x} div {2 * k + 2}))"  # noqa: B023, E731
            c = of(size)
            fresh = "true" if more == 0 else f"({_bound(longer, min_chars, edits)} <> {k} OR {of(longer)} <> {c})"
            starts = [(0, "0"), (k, f"n - {c}"), *((j, f"{j} * {c} + {by}") for j in range(1, k) for by in range(k))]
            for j, start in starts:
                kind = 2 if k > 1 else 0 if j == 0 else 1
                named = f"named_struct('kind', {kind}, 'key', xxhash64({k}, {j}, {c}, substring(line, 1 + {start}, {c})))"
                parts.append(f"IF({_bound(size, min_chars, edits)} = {k} AND {fresh}, {named}, NULL)")
    return F.expr(f"filter(array({', '.join(parts)}), x -> x IS NOT NULL)")


def _one_edit(texts: DataFrame) -> DataFrame:
    """ord, partner (earlier): lines one edit apart, told from the deletion variants. texts: ord, line, n, first, last."""
    c = "(2 * ((n - 1) div 4))"
    # No neighbour but with the first part alone: the edit lies behind it, from `lo` on; with the last alone: before `hi`.
    ranged = texts.withColumn("lo", F.expr(f"IF(last, 0, {c})")).withColumn("hi", F.expr(f"IF(first, n, n - {c})"))
    each = ranged.withColumn("s", F.explode(F.expr(f"sequence(lo div {SEGMENT}, hi div {SEGMENT})")))
    before, behind, closer = f"substring(line, 1, s * {SEGMENT})", f"substring(line, (s + 1) * {SEGMENT} + 1, n)", f"substring(line, (s + 1) * {SEGMENT}, n)"
    cut = each.selectExpr(
        "ord", "s", f"lo - s * {SEGMENT} AS lo", f"hi - s * {SEGMENT} AS hi", f"substring(line, s * {SEGMENT} + 1, {SEGMENT}) AS seg",
        *(f"xxhash64({seed}, {what}) AS {name}{seed}" for name, what in (("b", before), ("d", behind), ("w", closer)) for seed in (1, 2)),
    )
    # -1: the line itself, as the variant of one a character longer.
    end = "(least(length(seg), hi) - 1)"
    places = f"concat(array(-1L), IF(greatest(lo, 0) <= {end}, sequence(cast(greatest(lo, 0) AS bigint), cast({end} AS bigint)), array()))"
    variants = cut.withColumn("at", F.explode(F.expr(places)))
    lacking = f"IF(at < 0, substring(seg, 1, {SEGMENT - 1}), concat(substring(seg, 1, cast(at AS int)), substring(seg, cast(at + 2 AS int))))"
    keyed = variants.selectExpr("ord", "at", *(f"xxhash64({seed}, s, b{seed}, IF(at < 0, w{seed}, d{seed}), {lacking}) AS k{seed}" for seed in (1, 2)))
    # Of one key are at most as many lines as there are characters to put in: windows stay small.
    of_key, of_place = Window.partitionBy("k1", "k2"), Window.partitionBy("k1", "k2", "at")
    # By the key first: what is dealt out by it serves the windows of a place as well.
    met = keyed.withColumn("whole", F.min(F.expr("IF(at < 0, ord, NULL)")).over(of_key)).withColumn("lacks", F.min(F.expr("IF(at >= 0, ord, NULL)")).over(of_key))
    met = met.withColumn("same", F.min("ord").over(of_place))
    return met.selectExpr("ord", "IF(at < 0, lacks, least(whole, same)) AS partner").where("partner < ord").distinct()


def _choices(spark: SparkSession, edits: int) -> DataFrame:
    """k, t (segments that the edits touch, each by one at least), more (length above the shorter line's), choice, m, w (the segments), c (how far
    what follows each has moved, from 0 on). Of two lines as long as each other either can be the shorter: up to three edits, the one that loses a
    character first."""
    rows = []
    for k in range(2, edits + 1):
        m = k + SEGMENTS_MORE
        for t in range(1, k + 1):
            for w in combinations(range(m), t):
                for d in product(range(-k, k + 1), repeat=t):
                    if sum(max(1, abs(x)) for x in d) <= k and (sum(d) > 0 or (sum(d) == 0 and (k > 3 or d >= (0,) * t))):
                        rows.append((k, t, sum(d), len(rows), m, list(w), [0, *accumulate(d)]))
    return spark.createDataFrame(rows, "k int, t int, more int, choice int, m int, w array<int>, c array<int>")


#: Where chosen segment i starts and ends in the shorter line, as a place from 0; what lies between them, and the segments.
_START, _END = "cast(w[{0}] * size div m AS int)", "cast((w[{0}] + 1) * size div m AS int)"
_BETWEEN = f"transform(sequence(0, t), i -> substring(s, 1 + IF(i = 0, 0, {_END.format('i - 1')}) + c[i], IF(i = t, size, {_START.format('i')}) - IF(i = 0, 0, {_END.format('i - 1')})))"
_WITHIN = f"transform(sequence(0, t - 1), i -> substring(s, 1 + {_START.format('i')} + c[i], {_END.format('i')} - {_START.format('i')} + c[i + 1] - c[i]))"


def _keyed(state: DataFrame, choices: DataFrame, k: str) -> DataFrame:
    """Rows of state (ord, h1, of, s, more, and k after the first round) by choices, with size, the length of the shorter line, plain (as the shorter
    line has it: nothing has moved) and key."""
    each = state.withColumn("size", F.expr("cast(length(s) - more AS int)")).withColumn("k", F.expr(f"cast({k} AS int)"))
    each = each.where("size >= 0 AND more <= k").join(F.broadcast(choices), ["k", "more"]).withColumn("plain", F.expr("forall(c, x -> x = 0)"))
    return each.withColumn("key", F.expr(f"xxhash64(of, k, size, w, {_BETWEEN})"))


def _several(rows: DataFrame) -> DataFrame:
    """key, n: keys that two lines have, one of them as the shorter, and how many rows; staged."""
    counted = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("h1").alias("least"), F.max("h1").alias("greatest"), F.max("plain").alias("plain"))
    return staged(counted.where("least < greatest AND plain").select("key", "n"), "met-keys")


def _alike(texts: DataFrame) -> DataFrame:
    """h: hashes of (key, x) of the texts x (staged) from which another of their key is one edit away, told from variants without a character; staged."""
    # A replaced character: equal variants at one place. One put in: a variant that is another's whole text.
    at = texts.select(F.xxhash64("key", "x").alias("h"), "key", "x", F.explode(F.expr("sequence(0, length(x))")).alias("at")).withColumn("whole", F.expr("at = length(x)"))
    lacks = at.withColumn("lacks", F.expr("concat(substring(x, 1, at), substring(x, at + 2))"))
    both = "filter(array(IF(whole, NULL, struct(xxhash64(key, at, lacks) AS key, CAST(NULL AS boolean) AS whole)), struct(xxhash64(key, -1, lacks) AS key, whole)), v -> v IS NOT NULL)"
    keyed = lacks.select("h", F.explode(F.expr(both)).alias("v")).select("h", "v.*")
    sums = (F.min("h").alias("least"), F.max("h").alias("greatest"), F.min("whole").alias("some_lack"), F.max("whole").alias("some_whole"))
    shared = staged(keyed.groupBy("key").agg(*sums).where("least < greatest AND (some_whole IS NULL OR (some_whole AND NOT some_lack))").select("key"), "near-variants")
    out = staged(maybe_in(keyed, "key", shared).join(shared.hint("merge"), "key", "left_semi").select("h").distinct(), "near-segments")
    discard(shared)
    return out


def _possible(hot: DataFrame, edits: int) -> DataFrame:
    """Of the rows of hot keys those that can have a partner there, with n counted anew; staged.

    Where as many segments as edits are chosen, each differs by one edit: in each a line of the same key has a text one edit away.
    """
    rows = hot.drop("n")
    for j in range(edits):
        texts = staged(rows.where(f"t = k AND t > {j}").select("key", F.col("segs")[j].alias("x")).distinct(), "segments")
        alike, before = _alike(texts), rows
        flagged = maybe(rows.withColumn("h", F.expr(f"IF(t > {j}, xxhash64(key, segs[{j}]), NULL)")), "h", alike)
        rows = staged(flagged.where(f"t < k OR t <= {j} OR __maybe").drop("h", "__maybe"), "possible-lines")
        discard(texts, alike, before)
        tidy(hot.sparkSession)
    counts = _several(rows)
    left = staged(spread_join(maybe_in(rows, "key", counts), counts, ["key"], "n", "ord"), "met-lines")
    discard(rows, counts)
    return left


def _more_edits(texts: DataFrame, min_chars: int, edits: int) -> tuple[DataFrame, list[DataFrame]]:
    """ord: lines with an earlier neighbour; tables of ord, partner (earlier): pairs to verify; both where the bound is two or more, and staged."""
    choices = _choices(texts.sparkSession, edits)
    state, k = texts.select("ord", "h1", F.lit(0).cast("long").alias("of"), F.col("line").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("more")), _bound("size", min_chars, edits)
    # Lines of a key differ in its segments alone, so the edits of these bound those of the lines.
    apart = f"aggregate(zip_with(x.segs, y.segs, (a, b) -> levenshtein(a, b, {edits})), 0, (n, d) -> IF(n < 0 OR d < 0, -1, n + d)) BETWEEN 0 AND k"
    near, pairs = None, []
    for depth in count(1):
        keyed = _keyed(state, choices, k)
        counts = _several(keyed)
        segs = maybe_in(keyed, "key", counts).select("ord", "h1", "key", "k", "t", "more", "plain", F.expr(_WITHIN).alias("segs"))
        met = staged(spread_join(segs, counts, ["key"], "n", "ord"), "met-lines")
        few, many = met.where(F.col("n") <= FEW), met.where(F.col("n") > FEW)
        ends, left = many.isEmpty(), met
        if not ends:
            left = _possible(many, edits)
            few, many = few.unionByName(left.where(F.col("n") <= FEW)), left.where(F.col("n") > FEW)
            ends = many.isEmpty()
        groups = few.groupBy("key").agg(F.first("k").alias("k"), F.collect_set(F.struct("ord", "segs")).alias("g"))
        if depth == 1:
            near = groups.select(F.explode(F.expr(f"filter(g, x -> exists(g, y -> y.ord < x.ord AND {apart}))")).alias("x")).select("x.ord").distinct()
            near = staged(near, "near-ones")
        else:  # segments of segments: what was between them is out of sight, so the lines themselves are verified
            close = groups.select(F.explode(F.expr(f"flatten(transform(g, x -> transform(filter(g, y -> y.ord < x.ord AND {apart}), y -> struct(x.ord AS ord, y.ord AS partner))))")).alias("x")).select("x.*").distinct()
            pairs.append(staged(close, "near-pairs"))
        last = [state] if depth > 1 else []
        if ends:
            discard(counts, met, left, *last)
            break
        # The shorter line of a key stays the shorter one: of a pair it is in the next keys as it is. `settled` is by key, of its characters.
        settled, s = F.expr("aggregate(segs, 0, (n, x) -> n + length(x)) - more <= 2 * k"), F.array_join("segs", "")
        rest = many.where(settled).select("key", "k", "ord", "segs").distinct()
        earlier = rest.select("key", F.col("ord").alias("partner"), "segs")
        close = rest.alias("x").join(earlier.alias("y"), "key").where(f"partner < ord AND {apart}").select("ord", "partner").distinct()
        pairs.append(staged(close, "near-pairs"))
        state, k = staged(many.where(~settled).select("ord", "h1", F.col("key").alias("of"), s.alias("s"), "more", "k").distinct(), "lines-again"), "k"
        discard(counts, met, left, *last)
        tidy(texts.sparkSession)
    return near, pairs


def _near(lines: DataFrame, min_chars: int, edits: int) -> DataFrame:
    """h1, h2 of the lines that an earlier one is near to; staged."""
    long = lines.where(F.col("n") >= min_chars).withColumn("part", F.explode(_parts(min_chars, edits))).select("*", "part.kind", "part.key").drop("part")
    # A part that two lines have: lines are told apart by half their hash.
    shared = long.groupBy("key").agg(F.count("*").alias("n"), F.min("h1").alias("least"), F.max("h1").alias("greatest")).where("least < greatest").select("key", "n")
    shared = staged(shared, "shared-parts")
    hits = spread_join(maybe_in(long.withColumnRenamed("n", "chars"), "key", shared), shared, ["key"], "n", "ord")
    flags = (F.max(F.col("kind") == k).alias(name) for k, name in enumerate(("first", "last", "more")))
    texts = staged(hits.groupBy("h1", "h2").agg(F.min("ord").alias("ord"), F.first("line").alias("line"), F.first("chars").alias("n"), *flags), "candidate-lines")

    partners, known, used = _one_edit(texts.where("first OR last")), None, []
    if edits > 1:
        known, further = _more_edits(texts.where("more"), min_chars, edits)
        partners, used = reduce(DataFrame.unionByName, further, partners).distinct(), [known, *further]
    bound = _bound("least(length(ours), length(theirs))", min_chars, edits)
    near = F.expr(" OR ".join(f"({bound} = {k} AND levenshtein(ours, theirs, {k}) >= 0)" for k in range(1, edits + 1)))
    left, right = texts.select("ord", F.col("line").alias("ours")), texts.select(F.col("ord").alias("partner"), F.col("line").alias("theirs"))
    close = partners.join(left, "ord").join(right, "partner").where(near).select("ord")
    close = close.distinct() if known is None else close.unionByName(known).distinct()
    out = staged(texts.select("ord", "h1", "h2").join(close, "ord").select("h1", "h2"), "near-lines")
    discard(shared, texts, *used)
    return out


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, equal_chars: int = MIN_CHARS, edits: int = 1) -> DataFrame:
    """row, places: the places of the lines that go, for each of the numbered docs that loses any; staged."""
    lines = _lines(docs, min_chars, equal_chars)
    near = _near(lines, min_chars, edits)
    equal = lines.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    judged = equal.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "full_outer").select("h1", "h2", "first", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("near", F.lit(False)).alias("near"))
    judged = staged(judged, "judged-lines")
    # Occurrences that go: all of a line with an earlier neighbour, and all but the first of the others.
    found = spread_join(maybe_in(lines.select("ord", "h1", "h2"), "h1", judged), judged, ["h1", "h2"], "n", "ord").where("near OR ord <> first")
    spot = F.expr(f"cast(ord % {_ROWS * _LINES}BD AS bigint)")
    gone = found.select(F.shiftright(spot, 28).alias("row"), spot.bitwiseAND(F.lit(_LINES - 1)).cast("int").alias("place"))
    out = staged(gone.groupBy("row").agg(F.collect_set("place").alias("places")), "lost-lines")
    discard(near, judged)
    tidy(docs.sparkSession)
    return out


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, equal_chars: int = MIN_CHARS, edits: int = 1) -> DataFrame:
    """id, docs' columns as c0, c1 and so on, kept (the text that is left), n_lines, n_removed: a row for each of docs."""
    docs = numbered(docs)
    gone = repeated_lines(docs, min_chars, equal_chars, edits)
    # Only texts that lose a line, and a few others, move to meet their losses.
    flagged, own = maybe(docs, "row", gone), [c for c in docs.columns if c not in ("row", "id", "text")]
    whole = flagged.where(~F.col("__maybe")).withColumn("places", F.lit(None).cast("array<int>"))
    losing = flagged.where("__maybe").join(gone.hint("merge"), "row", "left")
    joined = whole.unionByName(losing).withColumn("every", F.split("text", "\n", -1))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(every) - 1), places), i -> every[i]), '\n')")
    return joined.select(
        "id", *own, F.when(F.col("places").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        F.size("every").cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size("places"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, edits: int = 1) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text: a row for each document."""
    out = drop_repeated_lines(docs.select("doc_id", "text"), min_chars, edits=edits)
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.col("kept").alias("kept_text"))


def strip_documents(docs: DataFrame, min_chars: int = MIN_CHARS, equal_chars: int = 1, edits: int = EDITS) -> DataFrame:
    """docs in its own columns, texts without the repeated lines; documents that lose every line go. n_chars, if there, is the new text's."""
    out = drop_repeated_lines(docs, min_chars, equal_chars, edits).where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_removed") == 0))
    untouched = F.col("n_removed") == 0

    def column(i: int, name: str) -> Column:
        own = F.col(f"c{i}")
        if name == "text":
            return F.when(untouched, own).otherwise(F.col("kept")).alias(name)
        return F.when(untouched, own).otherwise(F.length("kept")).cast(docs.schema[name].dataType).alias(name) if name == "n_chars" else own.alias(name)

    return out.select(*(column(i, name) for i, name in enumerate(docs.columns)))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("kept_text").cast("long").alias("kept_chars"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


# One edit apart, told from the deletion variants: by equal variants at one place, or a line that is another's variant.
SQL = r"""
WITH line AS (
    SELECT doc_id, p, string_split(coalesce(text, ''), chr(10))[p] AS l
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS p FROM documents)),
first AS (
    SELECT l, row_number() OVER (ORDER BY min((doc_id, p))) AS o, min((doc_id, p)) AS spot
    FROM line WHERE length(l) >= 20 GROUP BY l),
variant AS (
    SELECT o, i, substr(l, 1, i - 1) || substr(l, i + 1) AS v
    FROM (SELECT o, l, unnest(range(1, length(l) + 1)) AS i FROM first)),
near AS (
    SELECT o FROM (SELECT o, min(o) OVER (PARTITION BY v, i) AS m FROM variant) WHERE m < o
    UNION SELECT b.o FROM variant a JOIN first b ON a.v = b.l WHERE a.o < b.o
    UNION SELECT a.o FROM variant a JOIN first b ON a.v = b.l WHERE b.o < a.o),
gone AS (
    SELECT DISTINCT doc_id, p FROM line JOIN first USING (l)
    WHERE o IN (SELECT o FROM near) OR (doc_id, p) <> spot),
kept AS (
    SELECT doc_id, count(*) FILTER (WHERE g IS NOT NULL) AS n_removed, count(*) AS n_lines,
           coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (WHERE g IS NULL), '') AS t
    FROM line LEFT JOIN (SELECT doc_id, p, 1 AS g FROM gone) USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(t)::BIGINT AS kept_chars, sha256(t) AS kept_sha256
FROM kept
"""
