"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line goes when it is a further copy of a line, or when a line before it (by doc_id, then
place in the text) lies within ``threshold`` edits of it.  Lines of up to (threshold + 1)
squared characters have segments no longer than the threshold and go only as further copies:
most of them lie within the threshold of each other.  Their links are found and counted all
the same, apart from the others (``n_short_links``), and remove nothing.  Blank lines always
stay and have no links, and so do lines below ``least_chars`` characters, if a caller sets it.

Join: two lines within t edits, one cut into t + 1 segments, share at least one segment
unchanged, near its place.  Every distinct line is indexed under (its length, segment
number, segment) and probes the index of each length from its own down to t less, at
the few places where that segment can stand (multi-match-aware windows).  A probe meets one
row a key: how many lines are indexed there.  Only lines of keys that hold two different
lines are looked up with their texts; the indexed ones are dealt to tiles of about ``TILE``
lines, and a probing line is compared in place with each tile, so lines that share a segment
never become rows pair by pair.  A pair is cut down to where it differs, and a banded
bit-parallel automaton decides: one word of 2t + 1 bits, a bit for each diagonal of the
band, for each number of edits up to t.

Links of short lines, to each other and to longer ones, come from deletion neighbourhoods: two
lines within t edits have a string in common that is left of either when up to t characters
are taken out.  All such strings of a line are its keys; lines of a key are compared in tiles.

Copies are grouped before segments are made, so a line that repeats everywhere is indexed
once.  Lines are named by 95 bits of hashes, rows by 128.

Defined results: a null text stays null and has no lines; an empty text has one line and
stays; documents whose lines all go keep an empty text; rows that are equal in every column
are numbered, and lines of all but one are further copies; rows with equal ids are told
apart by their columns; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import keyed, stored

BLOCK = 16
TILE = 32
WINDOW = 24


def segment(line: Column, base: Column, extra: Column, number: int, parts: int, shift: int = 0) -> Column:
    """Segment ``number`` of ``parts``, taken ``shift`` later; ``base`` and ``extra`` are
    the quotient and the rest of the indexed line's length by ``parts``."""
    early = F.lit(parts) - extra  # the last ``extra`` segments are one longer
    start = base * (number - 1) + F.greatest(F.lit(0), F.lit(number - 1) - early)
    size = base + (F.lit(number) > early).cast("int")
    return line.substr(start + (shift + 1), size)


def measured(lines: DataFrame, threshold: int) -> DataFrame:
    """``lines`` with the numbers that segments need, computed once for a line."""
    parts, cols = threshold + 1, []
    for less in range(parts):
        n = F.length("line") - less
        cols += [n.alias(f"n{less}"), F.expr(f"CAST((length(line) - {less}) DIV {parts} AS INT)").alias(f"base{less}"), (n % parts).alias(f"extra{less}")]
    return lines.select("*", *cols)


def segment_keys(threshold: int) -> Column:
    """Keys of a line of ``measured``: (length, number, segment) of each of its own segments,
    under which it is indexed, then those of all indexed lines, not longer than this, that may
    lie within the threshold.  It probes all of them.

    A place before the line's start can't come up: segments are longer than the threshold.
    """
    parts, own, other = threshold + 1, [], []
    for less in range(threshold + 1):
        base, extra = F.col(f"base{less}"), F.col(f"extra{less}")
        for i in range(1, parts + 1):
            first = max(-(i - 1), less - (parts - i))
            last = min(i - 1, less + (parts - i))
            for s in range(first, last + 1):
                key = F.xxhash64(f"n{less}", F.lit(i), segment(F.col("line"), base, extra, i, parts, s))
                (other if less or s else own).append(key)
    return F.array(*own, *other)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shared(same, most: Column) -> Column:
    """How many characters two strings share at an end, ``most`` at most, in whole blocks:
    ``same(at, size)`` compares ``size`` characters after the first ``at``.  Steps are halved,
    from the largest that ``most`` holds."""

    def halved(most: Column) -> Column:
        first = F.floor(F.log2(F.greatest(most / BLOCK, F.lit(1.0)))).cast("int")
        sizes = F.transform(F.sequence(first, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(BLOCK), k))
        return F.aggregate(sizes, F.lit(0), lambda at, size: F.when(at + size > most, at).when(same(at, size), at + size).otherwise(at))

    return let(most, halved)


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda ch: ch != "")


def reached(a: Column, b: Column, threshold: int) -> Column:
    """The automaton's last word after all characters of the array b, a being another one.

    After j characters of b, bit d of word e says that j + d - threshold characters of a
    can be reached with e edits.
    """
    band = (1 << (2 * threshold + 1)) - 1
    words = [f"e{e}" for e in range(threshold + 1)]
    start = F.struct(*[F.lit(sum(1 << (threshold + i) for i in range(e + 1))).cast("int").alias(w) for e, w in enumerate(words)])

    def step(state: Column, j: Column) -> Column:
        ch = F.get(b, j)
        match = F.lit(0)
        for d in range(2 * threshold + 1):
            equal = F.coalesce(F.get(a, j + (d - threshold)) == ch, F.lit(False))
            match = match.bitwiseOR(F.when((j + (d - threshold) >= 0) & equal, F.lit(1 << d)).otherwise(F.lit(0)))

        def advance(match: Column) -> Column:
            new: list[Column] = []
            for e, w in enumerate(words):
                value = state[w].bitwiseAND(match)
                if e:
                    fewer = state[words[e - 1]]
                    value = value.bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1))
                    value = value.bitwiseOR(F.shiftleft(new[-1], 1).bitwiseAND(F.lit(band)))
                new.append(value)
            return F.struct(*[v.cast("int").alias(w) for v, w in zip(new, words, strict=True)])

        # Once no diagonal is left, the rest of the text can't change that.
        return F.when(state[words[-1]] == 0, state).otherwise(let(match, advance))

    steps = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda s: s[words[-1]])


def within(x: Column, y: Column, threshold: int) -> Column:
    """True if the two strings lie within ``threshold`` edits.

    What both share at their ends, in whole blocks, is left out.  The automaton runs over
    the first ``WINDOW`` characters after the shared front and, only if a diagonal is left
    then, over all that is in between.
    """
    apart, least = F.length(x) - F.length(y), F.least(F.length(x), F.length(y))
    run = lambda a, b: let(F.struct(characters(a).alias("a"), characters(b).alias("b")), lambda c: reached(c["a"], c["b"], threshold))
    front = shared(lambda at, size: x.substr(at + 1, size) == y.substr(at + 1, size), least)
    end = lambda s, at, size: s.substr(F.length(s) - at - size + 1, size)
    back = lambda f: shared(lambda at, size: end(x, at, size) == end(y, at, size), least - f)

    def whole(f: Column) -> Column:
        mid = lambda s, cut: s.substr(f + 1, F.length(s) - f - cut)
        last = let(back(f), lambda cut: run(mid(x, cut), mid(y, cut)))
        return F.call_function("shiftright", last, F.greatest(apart + threshold, F.lit(0))).bitwiseAND(F.lit(1)) == 1

    def decided(f: Column) -> Column:
        # Prefixes of one length of two strings within t edits lie within 2 t edits.
        begins = F.levenshtein(x.substr(f + 1, F.lit(WINDOW)), y.substr(f + 1, F.lit(WINDOW)), 2 * threshold) >= 0
        return F.when(begins, whole(f)).otherwise(False)

    return F.when(F.abs(apart) <= threshold, let(front, decided)).otherwise(False)


def counts_as_line(line: Column, least_chars: int) -> Column:
    return (F.length(line) >= least_chars) & (F.trim(line) != "")


def occurrences(documents: DataFrame, least_chars: int) -> DataFrame:
    """(h, h2, first, line) of every line that counts; ``first`` is its place in the corpus."""
    rows = keyed(documents).select("doc_id", "r1", "r2", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    place = F.struct("doc_id", "place", "r1", "r2")
    return rows.where(counts_as_line(F.col("line"), least_chars)).select(F.xxhash64("line").alias("h"), F.hash("line").bitwiseAND(F.lit(-2)).alias("h2"), place.alias("first"), "line")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(h, h2, line, first, copies): distinct lines, dealt out by their hashes.

    The last condition always holds.  It keeps every consumer's plan down to the exchange
    the same, so lines are shuffled once.
    """
    grouped = lines.groupBy("h", "h2").agg(F.min("line").alias("line"), F.min("first").alias("first"), F.count("*").alias("copies"))
    return grouped.where("copies > 0 AND first IS NOT NULL AND line IS NOT NULL")


def met_lines(distinct: DataFrame, threshold: int) -> DataFrame:
    """(h, h2, line, first, copies, key, n): lines under each key that holds an indexed line
    and another one, ``n`` lines being indexed there; without a key, lines with copies."""
    numbers = measured(distinct.where(F.length("line") > (threshold + 1) ** 2), threshold)
    keys = numbers.select("h", "h2", F.posexplode(segment_keys(threshold)).alias("at", "key"))
    # The last bit of h2 is free: it marks a line's own keys.  Keys are dealt out once, for the
    # index and for the probes; the outer explode keeps the index's filter behind that.
    dealt = keys.select("key", "h", F.col("h2").bitwiseOR((F.col("at") <= threshold).cast("int")).alias("tag")).repartition("key")
    own = F.when(F.col("tag").bitwiseAND(F.lit(1)) == 1, F.array(F.struct("h", "tag")))
    index = dealt.select("key", F.explode_outer(own).alias("own")).where("own IS NOT NULL")
    held = index.groupBy("key").agg(F.count("*").alias("n"), F.min("own.h").alias("one"), F.min("own.tag").alias("one2"))
    met = dealt.join(held, "key").where("n > 1 OR one != h").select("key", "n", "one", F.col("one2").bitwiseAND(F.lit(-2)).alias("one2"), "h", F.col("tag").bitwiseAND(F.lit(-2)).alias("h2"))
    # Where several lines are indexed they all meet their own key; a single one is added.
    members = F.array(F.struct("h", "h2"), F.when(F.col("n") == 1, F.struct(F.col("one").alias("h"), F.col("one2").alias("h2"))))
    wanted = met.select("key", "n", F.inline(F.filter(members, lambda m: m.isNotNull()))).distinct()
    found = distinct.join(wanted, ["h", "h2"], "left").where("key IS NOT NULL OR copies > 1")
    return found.select("h", "h2", F.when(F.col("key").isNotNull(), F.col("line")).alias("line"), "first", "copies", "key", "n")


def near_pairs(met: DataFrame, threshold: int) -> DataFrame:
    """(a, b): names and first places of the lines of each pair within the threshold; a pair
    comes once for each key at which it meets."""
    rows = measured(met.where("key IS NOT NULL"), threshold)
    rows = rows.select("h", "h2", "line", "first", "key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), F.array_contains(F.slice(segment_keys(threshold), 1, threshold + 1), F.col("key")).alias("indexed"))
    own = F.pmod(F.xxhash64(F.lit("tile"), "h", "h2"), F.col("tiles")).cast("int")
    tiles = rows.where("indexed").groupBy("key", own.alias("tile")).agg(F.collect_list(F.struct("h", "h2", "line", "first")).alias("held"))
    asks = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "indexed", "h", "h2", "line", "first")

    def near(m: Column) -> Column:
        name, other = F.struct("h", "h2"), F.struct(m["h"].alias("h"), m["h2"].alias("h2"))
        once = F.when(F.col("indexed"), name < other).otherwise(name != other)  # two indexed lines ask each other
        return F.when(once, within(F.col("line"), m["line"], threshold)).otherwise(False)

    # The outer form: for the inner one Spark adds a filter that compares everything again.
    found = asks.join(tiles, ["key", "tile"]).select("h", "h2", "first", F.explode_outer(F.filter("held", near)).alias("m")).where("m IS NOT NULL")
    return found.select(F.struct("h", "h2", "first").alias("a"), F.struct("m.h", "m.h2", "m.first").alias("b"))


def left_over(line: Column, most: int) -> Column:
    """The distinct strings that are left of a line when up to ``most`` characters are taken out."""

    def shorter(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))

    found = last = F.array(line)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda s: F.length(s) > 0), shorter)))
        found = F.concat(found, last)
    return F.array_distinct(found)


def short_links(documents: DataFrame, threshold: int, least_chars: int) -> DataFrame:
    """(h, h2, short): the number of different lines within the threshold, this line or the
    other one having no more than (threshold + 1) squared characters; only lines with such links."""
    limit = (threshold + 1) ** 2
    lines = F.filter(F.split("text", "\n"), lambda x: (F.length(x) <= limit + threshold) & counts_as_line(x, least_chars))
    distinct = documents.select(F.explode(F.array_distinct(lines)).alias("line")).distinct()
    keys = stored(distinct.select("line", F.explode(F.transform(left_over(F.col("line"), threshold), lambda s: F.xxhash64(s))).alias("key")), "shorts")
    held = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = keys.join(held, "key").select("key", "line", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    tiles = rows.groupBy("key", F.pmod(F.xxhash64(F.lit("tile"), "line"), F.col("tiles")).cast("int").alias("tile")).agg(F.collect_list("line").alias("held"))
    asks = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "line")
    line = F.col("line")

    def near(m: Column) -> Column:
        return (m != line) & (F.least(F.length(m), F.length(line)) <= limit) & (F.levenshtein(line, m, threshold) >= 0)

    pairs = asks.join(tiles, ["key", "tile"]).select("line", F.explode_outer(F.filter("held", near)).alias("m")).where("m IS NOT NULL").distinct()
    return pairs.groupBy(F.xxhash64("line").alias("h"), F.hash("line").bitwiseAND(F.lit(-2)).alias("h2")).agg(F.count("*").alias("short"))


def marked_lines(documents: DataFrame, threshold: int, least_chars: int, short: bool = True) -> DataFrame:
    """(h, h2, links, later, short, first): how many near lines a line has, whether one of them
    comes first, how many links with short lines (with ``short``), and the place of the first
    copy, for lines that have any of these."""
    met = stored(met_lines(distinct_lines(occurrences(documents, least_chars)), threshold), "lines")
    pairs = near_pairs(met, threshold).select(F.inline(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))))
    once = pairs.groupBy("own.h", "own.h2", F.col("other.h").alias("oh"), F.col("other.h2").alias("oh2")).agg(F.max(F.col("own.first") > F.col("other.first")).alias("later"))
    near = once.groupBy("h", "h2").agg(F.count("*").alias("links"), F.max("later").alias("later"))
    kind = met.schema["first"].dataType
    none, nowhere = F.lit(0).cast("long"), F.lit(None).cast(kind).alias("first")
    copied = met.where("copies > 1").select("h", "h2", none, F.lit(False), none, "first")
    marks = near.select("*", none.alias("short"), nowhere).unionAll(copied)
    if short:
        marks = marks.unionAll(short_links(documents, threshold, least_chars).select("h", "h2", none, F.lit(False), "short", nowhere))
    return stored(marks.groupBy("h", "h2").agg(F.max("links").alias("links"), F.max("later").alias("later"), F.max("short").alias("short"), F.min("first").alias("first")), "marks")


def removals(documents: DataFrame, threshold: int, least_chars: int, short: bool = True) -> DataFrame:
    """(r1, r2, found): for rows with marked lines, the places (place, links, short, goes) of these."""
    marks = marked_lines(documents, threshold, least_chars, short).withColumnRenamed("first", "earliest")
    hit = occurrences(documents, least_chars).select("h", "h2", "first").join(marks, ["h", "h2"])
    goes = F.col("later") | F.coalesce(F.col("first") != F.col("earliest"), F.lit(False))
    return hit.groupBy("first.r1", "first.r2").agg(F.collect_set(F.struct("first.place", "links", "short", goes.alias("goes"))).alias("found"))


def dedup(documents: DataFrame, threshold: int = 2, least_chars: int = 1, counts: bool = True) -> DataFrame:
    """Documents without repeated lines, equal rows numbered and all but one emptied.

    With ``counts``, ``n_lines``, ``n_removed``, ``n_links`` (both lines being long enough for
    segments) and ``n_short_links`` (all others) are added in place of any columns of these
    names; without, the columns are those of the input.
    """
    rows = keyed(documents).groupBy("r1", "r2").agg(F.first("row").alias("row"), F.count("*").alias("equal"))
    joined = rows.join(removals(documents, threshold, least_chars, counts), ["r1", "r2"], "left")
    each = joined.select("row", F.coalesce("found", F.array().cast("array<struct<place:int,links:bigint,short:bigint,goes:boolean>>")).alias("found"), F.explode(F.sequence(F.lit(1), F.col("equal").cast("int"))).alias("number"))
    text, lines = F.col("row.text"), F.split("row.text", "\n")
    places = F.transform(F.filter("found", lambda m: m["goes"]), lambda m: m["place"])
    again = F.filter(lines, lambda x: ~counts_as_line(x, least_chars))
    once = F.filter(lines, lambda _, i: ~F.array_contains(places, i))
    kept = F.when(F.col("number") > 1, again).when(F.size(places) > 0, once).otherwise(lines)
    new = each.select("row", lines.alias("lines"), kept.alias("kept"), "found")
    fresh = F.when(F.size("kept") < F.size("lines"), F.array_join("kept", "\n")).otherwise(text)
    added = {
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long"),
        "n_removed": F.when(text.isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long"),
        "n_links": F.aggregate("found", F.lit(0).cast("long"), lambda s, m: s + m["links"]),
        "n_short_links": F.aggregate("found", F.lit(0).cast("long"), lambda s, m: s + m["short"]),
    }
    added = added if counts else {}
    given = [fresh.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in documents.columns if c not in added]
    return new.select(*given, *[v.alias(c) for c, v in added.items()])


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_links, text_sha256, n_short_links) of every document."""
    kept = dedup(documents.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "n_short_links")
