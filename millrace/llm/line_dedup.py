r"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A document's lines are its ``\n``-split parts; a line's words are what white space (0x20, 0x09, 0x0B-0x0D)
leaves. Every line with a word takes part; a line without words always stays. A line is a later match, and
removed, if a line before it (by doc_id, then line number) has a Jaccard similarity of word sets of ``percent``
hundredths or more; lines are judged on the input, not on what is left.

* Words become 63-bit ids that sort by rarity: the upper bits are the rarity class (logarithm of the count,
  over all documents, of the words in the word's hash bucket: a statistic of fixed size, which orders the
  ids, bounds the groups of frequent ones and decides no result), the lower ones a hash.
* Lines of equal word sets are one class, named by a 128-bit hash of the set and placed at its first line,
  so a line repeated a million times is joined once. Classes of one or two words match no other class.
* Prefix filter: two sets of sizes n and m can only match if they share one of each other's
  n - ceil(percent * n) + 1 rarest ids, and the smaller one (or equal, n <= m) if already its
  n - ceil(2 * percent / (1 + percent) * n) + 1 rarest have one. Length filter: n >= percent * m. Positional filter: after
  the first shared id, enough ids must be left for the overlap that is needed. Parity sketches of 128 bits, whose distance is
  a lower bound of the symmetric difference, let few other pairs through.
* The candidates' lines are fetched, and their whole id sets compared.

Defined results: null text has no lines; an empty table gives an empty result; of different texts under one
doc_id each is judged by itself, and of lines at one place (doc_id and line number) none is later; so a repeated
row loses nothing to its copies. A null doc_id matches nothing and keeps its lines; extra columns are kept by
``remove_lines``, and columns of any name may be among them.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import drop_tables, only, shared_table

#: White space inside a line besides the blank.
BLANKS = "\t\x0b\f\r"
#: Hash buckets of the word counts, and bits of an id below its rarity class.
BUCKETS, LOW_BITS = 131_072, 55
#: Spark's setting for the groups (2 to this power) that an aggregate's fast map holds: 65,536 by default, fewer than BUCKETS.
FAST_MAP = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
#: Prefix entries of one id that are sorted together: 2 to this power, about.
GROUP_BITS = 17
#: Rarity class from which on an id's entries of settled classes are kept apart from each other (words counted 4,096 times or so).
HOT = 36
#: Keys of classes are under 2 to this power; above it stands a distance of sketches.
KEY_BITS = 56
#: Parts of the ids that are joined one after the other, so that the join's shuffle files take up a part of the disk at a time.
SLICES = 3
#: At first, a class is compared with the NEAR classes before it, under each of its RAREST rarest ids and the LAST ones that a
#: partner of its size can share first: words that are new in an edited copy are rare, those it shares with other copies come later.
NEAR, RAREST, LAST = 5, 3, 3

#: Entries are shuffled as short rows: n, pos and a bit for settled are one long, id and salt or band another, ``at``, which is
#: the key (tables of longs are the faster ones; other ids of equal hash are but more candidates).
PLACE, SIZE, POS = "shiftleft(cast(n as bigint), 32) | 2 * pos", "shiftright({}.place, 32)", "shiftright({}.place & 4294967295L, 1)"


def spaced(text: str) -> Column:
    """``text`` with blanks for all white space inside lines."""
    c = F.col(text)
    return F.when(reduce(Column.__or__, [F.contains(c, F.lit(b)) for b in BLANKS]), F.translate(c, BLANKS, " " * len(BLANKS))).otherwise(c)


def text_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), line_no, line (of ``spaced`` text) of every line of a document with an id."""
    # the text's hash first: the text itself must not be carried along with each line
    texts = only(docs, "doc_id", "text").where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    # split in the generator: of a column, the optimizer asks whether it is empty, and each of its filters splits the text once more
    return texts.select("doc_id", "th", F.posexplode(F.split(spaced("text"), "\n")).alias("line_no", "line"))


def rarity_classes(docs: DataFrame) -> Column:
    """Rarity class (0 to 127) by hash bucket, as a constant array."""
    return rarity(docs)[0]


def rarity(docs: DataFrame) -> tuple[Column, int]:
    """Rarity class (0 to 127) by hash bucket, from the words of all lines, as a constant array, and a class that parts the words of a
    line about in halves; BUCKETS counts come to the driver."""
    # words of a text are the words of its lines: lines need not be told apart
    words = only(docs, "doc_id", "text").where("doc_id is not null").select(F.explode(F.split(F.replace(spaced("text"), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where("w <> ''")
    counts = words.groupBy((F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1))).cast("int").alias("b")).agg(F.count("*").alias("n"))
    conf = docs.sparkSession.conf
    before = conf.get(FAST_MAP)
    conf.set(FAST_MAP, str(max(int(before), BUCKETS.bit_length())))
    try:
        rows = counts.collect()
    finally:
        conf.set(FAST_MAP, before)
    classes = dict.fromkeys(range(BUCKETS), 0) | {r.b: min(127, int(3 * math.log2(r.n + 1))) for r in rows}
    weights = [0] * 128
    for r in rows:
        weights[classes[r.b]] += r.n
    # two fifths: frequent words are more often repeated in a line, where they count once
    middle = next((c for c, below in enumerate(accumulate(weights)) if 5 * below >= 2 * sum(weights)), 0)
    # no lambda here: only then the optimizer folds it into one constant. Small numbers, as every text of the plan spells them out
    return F.split(F.lit(" ".join(str(classes[b]) for b in range(BUCKETS))), " ").cast("array<bigint>"), middle


def word_ids(line: str, classes: Column) -> Column:
    """Distinct word ids of a line of ``spaced`` text, rarest first."""
    # never null, so that plain longs are sorted (in ANSI mode an element is not, and coalesce() goes); the hash is computed once
    rarity = lambda h: F.coalesce(classes[h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")], F.lit(0).cast("long"))
    return F.sort_array(F.transform(word_hashes(line), lambda h: F.shiftleft(rarity(h), LOW_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - LOW_BITS))))


def word_hashes(line: str) -> Column:
    """Distinct 64-bit word hashes of a line of ``spaced`` text."""
    # array_except() gives distinct elements: one pass for both
    return F.array_except(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def parity(ids: str, rarer: str) -> list[Column]:
    """A 128-bit parity sketch as two longs: each id toggles one bit, so sketches differ in no more bits than sets in ids.

    The first ``rarer`` of the sorted ids toggle bits of one long, the others of the other one; they must be told apart by value.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    # shiftleft takes the lowest 6 bits of the hash
    toggled = lambda part: F.aggregate(part, zero, lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", one, F.hash(x))))
    return [toggled(F.slice(ids, F.lit(1), F.col(rarer))).alias("s1"), toggled(F.slice(ids, F.col(rarer) + 1, F.size(ids))).alias("s2")]


def below(ids: str, bound: int) -> Column:
    """How many of the sorted ids are below ``bound``."""
    # compiled, unlike a lambda; sorting takes one pass, as all ids but one are in order
    return (F.array_position(F.sort_array(F.concat(ids, F.array(F.lit(bound).cast("long")))), F.lit(bound).cast("long")) - 1).cast("int")


def prefix_size(n: Column, percent: int) -> Column:
    """n - ceil(percent * n) + 1."""
    return (n - F.floor((n * percent + 99) / 100) + 1).cast("int")


def _need(n: str, m: str, percent: int) -> str:
    """Overlap that sets of sizes n and m need."""
    return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def _distance(x: str, y: str) -> str:
    return f"(bit_count({x}.s1 ^ {y}.s1) + bit_count({x}.s2 ^ {y}.s2))"


def _fits(x: str, y: str, percent: int) -> str:
    """Length, positional and sketch filters for entries x and y of the first id they share (pos from 0)."""
    n, m = SIZE.format(x), SIZE.format(y)
    need = _need(n, m, percent)
    return (
        # half of the sketch, without a division, rejects nearly all
        f"{100 + percent} * bit_count({x}.s1 ^ {y}.s1) <= {100 - percent} * ({n} + {m}) and {_distance(x, y)} <= {n} + {m} - 2 * {need} and least({n} - {POS.format(x)}, {m} - {POS.format(y)}) >= {need} "
        f"and 100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"
    )


def one_value(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, though a lambda reads it (a plain projection would move into the lambda)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _short(percent: int) -> str:
    """Last position (from 0) at which a set can first share an id with one of its size or larger."""
    return f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent}"


def _by_band(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Entries of the smaller and of the larger sets of the pairs, with a further join key: the larger one's size band.

    A smaller set's entry is repeated for every band that its partners can be in: from n up to n / percent, or less if
    its position leaves less to share. Under a hot id, two settled classes never meet: odd keys hold the settled larger
    sets, for smaller ones that are not settled.
    """
    # sizes of one band differ by seven ninths at most: with narrower ones fewer entries are compared, but smaller sets have more rows
    band = lambda n: f"2 * cast(floor(ln({n}) * 1.738) as int)"
    most = f"least(100 * n div {percent}, {100 + percent} * (n - pos) div {percent} - n)"
    hot = f"shiftrightunsigned(id, {LOW_BITS}) >= {HOT}"
    bands = F.expr(f"sequence({band('n')}, {band(most)} + 1, if({hot} and settled is null, 1, 2))")
    return entries.where(f"pos <= {_short(percent)}").withColumn("band", F.explode(bands)), entries.withColumn("band", F.expr(f"{band('n')} + if({hot} and settled, 1, 0)"))


def _classes(lines: DataFrame) -> DataFrame:
    """h1, h2, doc_id, line_no, th, n, s1, s2, prefix of the first line of each class, its number of lines, and key: numbers in the order of these lines.

    There is no th where each id has but one text.
    """
    per_doc = lines.groupBy("doc_id").agg(F.max("line_no").alias("line_no"), (F.min("th") < F.max("th")).alias("differ"))
    low, high, most, texts = per_doc.agg(F.min("doc_id"), F.max("doc_id"), F.max("line_no"), F.bool_or("differ")).first()
    bits = (most or 0).bit_length()
    if low is not None and not texts and (high - low + 1) << bits < 1 << KEY_BITS:
        # the place itself is a number that tells classes apart, and its least one needs no sorting of the lines: what
        # follows from the set is a key of the groups
        place = F.shiftleft(F.col("doc_id").cast("long") - F.lit(low).cast("long"), bits).bitwiseOR(F.col("line_no").cast("long"))
        firsts = lines.where("n > 0").groupBy("h1", "h2", "n", "s1", "s2", "prefix").agg(F.min(place).alias("key"), F.count("*").alias("lines"))
        doc_id = (F.shiftright("key", bits) + F.lit(low).cast("long")).cast(lines.schema["doc_id"].dataType)
        return firsts.select("h1", "h2", doc_id.alias("doc_id"), F.expr(f"cast(key & {(1 << bits) - 1}L as int)").alias("line_no"), "n", "s1", "s2", "prefix", "lines", "key")
    first = F.min(F.struct("doc_id", "line_no", "th", "n", "s1", "s2", "prefix")).alias("first")
    firsts = lines.where("n > 0").groupBy("h1", "h2").agg(first, F.count("*").alias("lines")).select("h1", "h2", "first.*", "lines")
    return firsts.orderBy("doc_id", "line_no", "h1", "h2").select("*", F.monotonically_increasing_id().alias("key"))


def _sets(docs: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, hashes of the classes named in ``pairs``, from their first lines."""
    named = pairs.select(F.col("x").alias("key")).union(pairs.select("y")).distinct()
    of_text = [c for c in ("doc_id", "th") if c in groups.columns]
    places = groups.select("key", "line_no", *of_text).join(named.hint("shuffle_hash"), "key")
    # bounded by the lines of one text
    per_doc = places.groupBy(*of_text).agg(F.collect_list(F.struct("key", "line_no")).alias("wanted"))
    # the hash join does not sort the texts
    texts = only(docs, "doc_id", "text").where("text is not null").withColumn("th", F.xxhash64("text")).join(per_doc.hint("shuffle_hash"), of_text)
    found = one_value(texts, "lines", F.split(spaced("text"), "\n")).select(F.explode(F.transform("wanted", lambda w: F.struct(w["key"].alias("key"), F.get("lines", w["line_no"]).alias("line")))).alias("w")).select("w.*")
    # rows that are repeated give a class more than once
    return found.select("key", word_hashes("line").alias("hashes")).groupBy("key").agg(F.first("hashes").alias("hashes"))


def _matched(docs: DataFrame, groups: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """key of the classes y of the pairs (x, y), x first, that match."""
    sets = _sets(docs, groups, pairs)
    # hash joins: sets are not sorted, and a key has but one
    of = lambda k: sets.select(F.col("key").alias(k), F.col("hashes").alias(f"of_{k}")).hint("shuffle_hash")
    both = pairs.join(of("x"), "x").join(of("y"), "y")
    overlap = F.size(F.array_intersect("of_x", "of_y"))
    return both.where(overlap * (100 + percent) >= (F.size("of_x") + F.size("of_y")) * percent).select(F.col("y").alias("key")).distinct()


def later_matches(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, th (hash of the text), line_no of every line that matches an earlier one (more than once if rows are repeated).

    A class is *settled* once any class with an earlier first line matches it: then all its lines go. First
    each class is compared, under a few of its prefix ids, with the earliest class and its nearest predecessors, and
    the likeliest of these by sketch is verified: a few candidates an entry. Only classes that this leaves open
    are compared with all earlier ones they share a prefix id with, so groups of many similar lines hardly meet
    pair by pair. Entries of frequent ids are dealt to groups of bounded size at first; later the join is by id and size band.
    """
    classes, middle = rarity(docs)
    ids = text_lines(docs).select("doc_id", "th", "line_no", word_ids("line", classes).alias("ids"))
    ids = ids.select("*", below("ids", middle << LOW_BITS).alias("rarer"))
    n = F.size("ids")
    lines = ids.select(
        "doc_id", "th", "line_no", F.xxhash64("ids").alias("h1"), F.xxhash64(F.lit(1), "ids").alias("h2"), n.alias("n"),
        F.when(n > 2, F.slice("ids", 1, prefix_size(n, percent))).alias("prefix"), *parity("ids", "rarer"),
    )
    lines = whole = shared_table(lines, "line-sets", codec="snappy")
    # the first line of each class; its copies are decided by it
    firsts = shared_table(_classes(whole), "line-classes", codec="snappy")
    lines = shared_table(whole.select("doc_id", "th", "line_no", "h1", "h2"), "lines")
    drop_tables(whole)
    groups = firsts.where("n > 2").select("key", "n", "s1", "s2", "prefix")
    entries = groups.select("key", "n", "s1", "s2", F.posexplode("prefix").alias("pos", "id"))
    # a rarity class tells about how many entries an id can have: frequent ones are dealt to several groups
    last = _short(percent)
    salt = F.expr(f"pmod(xxhash64(key), shiftleft(1L, greatest(0, cast(shiftrightunsigned(id, {LOW_BITS}) as int) div 3 - {GROUP_BITS})))")
    dealt = entries.where(f"pos < {RAREST} or pos <= {last} and pos > {last} - {LAST}").select("key", "s1", "s2", F.expr(PLACE).alias("place"), F.xxhash64("id", salt).alias("at"))
    by_place = Window.partitionBy("at").orderBy("key")
    entry = F.struct("key", "s1", "s2", "place")
    partners = [F.nth_value(entry, 1).over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)), *[F.lag(entry, k).over(by_place) for k in range(1, NEAR + 1)]]
    near = [p.alias(f"x{k}") for k, p in enumerate(partners)]
    # one partner a row: the filters for all of them in one row would make a method that the JVM leaves uncompiled
    met = dealt.select("key", "s1", "s2", "place", *near).select("key", "s1", "s2", "place", F.explode(F.array(*[f"x{k}" for k in range(len(near))])).alias("x")).alias("y")
    # distance above, key below: the least is the likeliest
    best = F.expr(f"shiftleft(cast({_distance('x', 'y')} as bigint), {KEY_BITS}) | x.key")
    near = met.where(F.expr("x.key <> y.key and " + _fits("x", "y", percent))).groupBy("key").agg(F.min(best).alias("best"))
    near = shared_table(near.select(F.expr(f"best & {(1 << KEY_BITS) - 1}L").alias("x"), F.col("key").alias("y")), "line-pairs")
    settled = shared_table(_matched(docs, firsts, near, percent), "lines-settled")
    # classes that an earlier one may settle but the nearest did not
    flagged = shared_table(groups.join(settled.withColumn("settled", F.lit(True)), "key", "left"), "line-prefixes", codec="snappy")
    entries = flagged.select("settled", "key", "n", "s1", "s2", F.posexplode("prefix").alias("pos", "id"))
    packed = lambda df: df.select("key", "s1", "s2", F.expr(f"{PLACE} | if(settled, 1, 0)").alias("place"), F.xxhash64("id", "band").alias("at"))
    n, m = SIZE.format("x"), SIZE.format("y")
    meet = F.expr(f"x.at = y.at and ({n} < {m} or {n} = {m} and x.key < y.key) and {_fits('x', 'y', percent)} and if(x.key < y.key, y.place, x.place) & 1 = 0")
    parts = []
    for k in range(SLICES):
        smaller, larger = map(packed, _by_band(entries.where(F.pmod("id", F.lit(SLICES)) == k), percent))
        pairs = smaller.hint("shuffle_hash").alias("x").join(larger.alias("y"), meet).select(F.least("x.key", "y.key").alias("x"), F.greatest("x.key", "y.key").alias("y"))
        parts.append(shared_table(pairs.distinct(), "line-pairs"))
    drop_tables(flagged)
    rest = shared_table(reduce(DataFrame.union, parts).distinct().join(near, ["x", "y"], "left_anti"), "line-pairs")
    matched = settled if rest.isEmpty() else settled.union(shared_table(_matched(docs, firsts, rest, percent), "lines-settled"))
    judged = firsts.select("h1", "h2", F.struct("doc_id", "line_no").alias("first"), "key", "lines").join(matched.withColumn("all", F.lit(True)).hint("shuffle_hash"), "key", "left")
    judged = judged.where("all or lines > 1").drop("key", "lines")
    gone = F.col("all").isNotNull() | (F.struct("doc_id", "line_no") > F.col("first"))
    return lines.select("doc_id", "th", "line_no", "h1", "h2").join(judged.hint("shuffle_hash"), ["h1", "h2"]).where(gone).select("doc_id", "th", "line_no")


def remove_lines(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` without the later matches: text rebuilt from the lines that stay, all other columns as they are,
    and n_lines, n_removed."""
    gone = F.sort_array(F.collect_set("line_no"))
    later = shared_table(later_matches(docs, percent).groupBy("doc_id", "th").agg(gone.alias("gone")), "later-lines").toDF("_id", "_th", "_gone")
    # a hash join does not sort the texts
    joined = docs.join(later.hint("shuffle_hash"), (docs["doc_id"] == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_th")), "left").drop("_id", "_th")
    split = F.split("text", "\n")
    joined = one_value(joined, "_lines", F.when(F.col("_gone").isNotNull(), split))
    # array_except() is linear in the lines, a look-up for each line is not
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.get("_lines", i)), "\n")
    return joined.withColumns({
        # a line more than line feeds: no second split
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_removed": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"),
        "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept),
    }).drop("_gone", "_lines")
