"""Line dedup by a segment-partition edit join, in DataFrame and SQL functions alone.

A line goes if an equal line stands earlier, or if a line near it first stood earlier (order: identifier, then line
number). Lines are compared without outer blanks; blank lines stay. Two lines are near if they are within t edits of
each other, where t grows with the length n of the shorter: ``t = min(most, floor((n + per_chars / 2) / per_chars))``.
One rule holds for lines of every length; where it gives 0 edits, near is equal.

* *Equal lines* meet by two 64-bit hashes; minima are taken map-side.
* *Segments.* Lines of like lengths form a class with one threshold t; their first and last characters make t + 1
  zones of one width, half of them counted from the left end, half from the right. If two lines are within t
  edits, then one end has fewer edits than zones, and there a zone i stands unchanged in both, shifted by i - 1 places at
  most from that end. So no more than three substrings of each zone need to be indexed: those at the offsets
  0, 1 and 3, whose differences are all shifts up to 3 (``OFFSETS``). Both lines have the same kind of keys, (class,
  end, zone, hash of the substring): 2 at threshold 1, 6 at 3, 12 at 5, and those of the classes of shorter partners
  near a class boundary.
* *Probing.* Keys that only one line has are dropped by a map-side minimum and maximum. Lines that share the others are
  candidate pairs.
* *Hot keys.* A key that more than ``most_pairs`` lines share makes no pairs: its lines are cut into blocks of about
  ``block`` lines, and each two blocks meet in one row, where a line looks for any near line that stands earlier, after one
  look at the earliest line of the key. So the rows grow with the square of blocks, not of lines, and no line is left
  out. Two lines that share several hot keys are compared under the least; letter counts exclude most others.
* *Verification* is Spark's ``levenshtein`` with a threshold, a compiled dynamic program in a band of that width. The
  bit-parallel recurrence can be had instead for pairs of cold keys (``Lines.bit_parallel``): two lines are cut to the part
  where they differ (``middles``), and its distance is found with one word of bits for each character, for middles of up to
  62 characters. In native functions it runs interpreted and cannot meet the time limits (figures in the README).

Mostly hashes are shuffled; texts of lines that share a key move once, those of hot keys once for each block they meet, and
whole texts once, to meet the line numbers that go. At most 2**20 slot numbers are broadcast, a proven bound, to leave out
most texts that no key is shared of; where all slots are taken, all lines are shuffled, which is linear.

Defined results: a null text has no lines and stays null; an empty text is one blank line; repeated rows with
one identifier count as one document (each loses what is found in any); rows without an identifier keep their text and
are compared with nothing; ties go by line number; an empty table gives an empty table; columns of the input may have
any other names (``n_lines`` and ``n_removed`` of the result are lengthened where the input has them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, shared_dir, stored, table

SLOTS = 1 << 20
#: Offsets whose differences are all shifts of 0, 1, 2 and 3 places at most.
OFFSETS = [(0,), (0, 1), (0, 1, 3), (0, 1, 3)]


@dataclass(frozen=True)
class Lines:
    #: Near lines may have one edit for each so many characters of the shorter line, rounded, up to ``most``.
    per_chars: int = 20
    most: int = 3
    #: From so many lines of one key on they meet in blocks.
    most_pairs: int = 64
    block: int = 128
    #: Verify pairs of cold keys by the bit-parallel recurrence instead of the compiled banded program.
    bit_parallel: bool = False

    def __post_init__(self):
        if not (1 <= self.most <= 7 and self.per_chars >= 6):
            raise ValueError("most must be 1 to 7 and per_chars 6 at least")  # else zones would be narrower than their offsets

    def edits(self, n: Column) -> Column:
        """The threshold of a pair whose shorter line has ``n`` characters."""
        return F.least(F.floor((n + self.per_chars // 2) / self.per_chars).cast("int"), F.lit(self.most))


#: The pipeline's near lines: up to five edits.
STAGE = Lines(most=5)


def _class(n: Column, p: Lines) -> tuple[Column, Column]:
    """Threshold and least length of the class of the lines of ``n`` characters."""
    t = p.edits(n)
    power = F.call_function("shiftleft", F.lit(1), F.floor(F.log2(n + F.lit(0.5))).cast("int"))
    half = power + F.shiftright(power, 1)
    return t, F.greatest(F.when(n >= half, half).otherwise(power), t * p.per_chars - p.per_chars // 2)


def _keys(lines: DataFrame, p: Lines) -> DataFrame:
    """(h1, key): a row for each indexed substring of each line.

    Characters are cut from four bytes each, where a place is found at once. Exploded arrays of one entry keep what
    is computed once from being computed again wherever it is used.
    """
    rows = lines.select("h1", F.explode(F.array(F.encode("line", "UTF-32"))).alias("u")).select("h1", "u", (F.octet_length("u") / 4).cast("int").alias("n"))
    # the class of each length that a shorter partner may have, once: at the greatest length
    rows = rows.select("h1", "u", "n", F.explode(F.sequence(F.lit(0), p.edits(F.col("n")))).alias("d")).select("h1", "u", "n", "d", (F.col("n") - F.col("d")).alias("m"))
    (t, least), (_, above) = _class(F.col("m"), p), _class(F.col("m") + 1, p)
    rows = rows.filter((F.col("m") > 0) & (t > 0) & (t >= F.col("d")) & ((F.col("d") == 0) | (least != above)))
    rows = rows.select("h1", "u", "n", t.alias("t"), least.alias("least")).select("h1", "u", "n", "t", "least", F.floor(F.col("least") / (F.col("t") + 1)).cast("int").alias("zone"))
    keys = []
    for end in (0, 1):
        for i in range(1, (p.most + 2 - end) // 2 + 1):
            fewest = 2 * i - 2 + end  # edits from which this end has i zones
            for at in OFFSETS[i - 1]:
                size = F.col("zone") - max(OFFSETS[i - 1])
                start = F.col("zone") * (i - 1) + at if not end else F.col("n") - F.col("zone") * i + at
                part = F.col("u").substr(4 * start + 1, 4 * size)
                keys.append(F.when(F.col("t") >= fewest, F.xxhash64("least", F.lit(2 * i + end), part)))
    return rows.select("h1", F.explode(F.array(*keys)).alias("key")).filter("key is not null")


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, no, line, h1, h2 of each line that is not blank."""
    lines = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "whole"))
    line = lines.select("doc", "no", F.trim("whole").alias("line")).filter("line <> ''")
    return line.select("doc", "no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"))


def _slot(c: str) -> Column:
    return F.pmod(F.col(c), F.lit(SLOTS)).cast("int")


def _picked(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` is in the one column of ``wanted``.

    At most 2**20 slot numbers are broadcast to leave out most other rows before the exact join.
    """
    w = wanted.columns[0]
    slots = wanted.select(_slot(w).alias("slot")).distinct()
    near = rows.join(F.broadcast(slots), _slot(column) == F.col("slot"), "left_semi")
    return near.join(wanted.hint("merge"), F.col(column) == F.col(w)).drop(w)


def _near(a: Column, b: Column, p: Lines) -> Column:
    """Whether two lines are within the threshold of the shorter."""
    most = p.edits(F.least(F.length(a), F.length(b)))
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.call_function("levenshtein", a, b, most) >= 0)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _word(f: str, *args) -> Column:
    return F.call_function(f, *args)


def bit_parallel(a: Column, b: Column) -> Column:
    """Edit distance of two texts of 1 to 62 characters: a column of the table is two words of bits."""
    bit = lambda k: _word("shiftleft", F.lit(1).cast("bigint"), k)

    def run(v: Column) -> Column:
        m = F.size(v["p"])
        mask = bit(m) - 1

        def step(st: Column, c: Column) -> Column:
            same = F.aggregate(F.sequence(F.lit(0), m - 1), F.lit(0).cast("bigint"), lambda e, i: F.when(F.get(v["p"], i) == c, e.bitwiseOR(bit(i))).otherwise(e))

            def column(eq: Column) -> Column:
                flat = (eq.bitwiseAND(st["up"]) + st["up"]).bitwiseXOR(st["up"]).bitwiseOR(eq).bitwiseAND(mask)
                return _let(flat, lambda xh: across(eq, xh))

            def across(eq: Column, xh: Column) -> Column:
                up, down = st["down"].bitwiseOR(mask - xh.bitwiseOR(st["up"])), st["up"].bitwiseAND(xh)
                return _let(F.struct(up.alias("up"), down.alias("down"), eq.bitwiseOR(st["down"]).alias("xv")), next_column)

            def next_column(h: Column) -> Column:
                shifted = F.struct(_word("shiftleft", h["up"], F.lit(1)).bitwiseOR(F.lit(1).cast("bigint")).bitwiseAND(mask).alias("up"), _word("shiftleft", h["down"], F.lit(1)).bitwiseAND(mask).alias("down"))
                score = st["score"] + _word("shiftright", h["up"], m - 1) - _word("shiftright", h["down"], m - 1)
                return _let(shifted, lambda g: F.struct(
                    g["down"].bitwiseOR(mask - h["xv"].bitwiseOR(g["up"]).bitwiseAND(mask)).alias("up"), g["up"].bitwiseAND(h["xv"]).alias("down"), score.alias("score"),
                ))

            return _let(same, column)

        return F.aggregate(v["q"], F.struct(mask.alias("up"), F.lit(0).cast("bigint").alias("down"), m.cast("bigint").alias("score")), step)["score"]

    return _let(F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("q")), run)


def middles(pairs: DataFrame) -> DataFrame:
    """Adds x and y: a_line and b_line without their common start and end, which are found by halving."""

    def same(most: Column, part) -> Column:
        steps = F.transform(F.sequence(F.floor(F.log2(most + F.lit(0.5))).cast("int"), F.lit(0)), lambda k: _word("shiftleft", F.lit(1), k))
        longer = lambda n, k: (n + k <= most) & (part("a_line", n, k) == part("b_line", n, k))
        return F.when(most > 0, F.aggregate(steps, F.lit(0), lambda n, k: F.when(longer(n, k), n + k).otherwise(n))).otherwise(0)

    n = {c: F.length(c) for c in ("a_line", "b_line")}
    out = pairs.withColumn("head", same(F.least(*n.values()), lambda c, at, k: F.substring(c, at + 1, k)))
    out = out.withColumn("tail", same(F.least(*n.values()) - F.col("head"), lambda c, at, k: F.substring(c, n[c] - at - k + 1, k)))
    cut = lambda c: F.substring(c, F.col("head") + 1, n[c] - F.col("head") - F.col("tail"))
    return out.withColumns({"x": cut("a_line"), "y": cut("b_line")}).drop("head", "tail")


def verified(pairs: DataFrame, p: Lines) -> DataFrame:
    """The pairs (a_line, b_line, ...) within their threshold."""
    if not p.bit_parallel:
        return pairs.filter(_near(F.col("a_line"), F.col("b_line"), p))
    m, n = F.length("a_line"), F.length("b_line")
    most = p.edits(F.least(m, n))
    cut = middles(pairs.withColumn("most", most).filter(F.abs(m - n) <= F.col("most")))
    x, y = F.length("x"), F.length("y")
    distance = F.when(F.least(x, y) == 0, F.greatest(x, y)).when(F.greatest(x, y) <= 62, bit_parallel(F.col("x"), F.col("y")))
    near = F.when(F.greatest(x, y) <= 62, distance <= F.col("most")).otherwise(_word("levenshtein", F.col("x"), F.col("y"), F.col("most")) >= 0)
    return cut.filter(near).drop("most", "x", "y")


def later_lines(lines: DataFrame, groups: DataFrame, p: Lines, where: str) -> DataFrame:
    """h1 of the lines (h1, line) near which another line first stood earlier."""
    keys = _keys(lines, p)
    met = keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select(F.col("key").alias("m_key"))
    met = stored(met, f"{where}/met")
    shared = keys.join(met.hint("merge"), F.col("key") == F.col("m_key"), "left_semi")
    rows = stored(shared.groupBy("key", "h1").agg(F.lit(1).alias("one")).select("key", "h1"), f"{where}/rows")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") > p.most_pairs)
    hot = stored(counts.select(F.col("key").alias("hot_key"), F.ceil(F.col("lines") / p.block).cast("int").alias("parts")), f"{where}/hot")
    ids = stored(rows.select(F.col("h1").alias("c_h1")).distinct(), f"{where}/ids")
    texts = _picked(lines, "h1", ids).groupBy("h1").agg(F.min("line").alias("line"))
    firsts = _picked(groups.select("h1", "first"), "h1", ids).groupBy("h1").agg(F.min("first").alias("first"))
    known = stored(texts.join(firsts.hint("merge"), "h1"), f"{where}/known")

    cold = rows.select("key", "h1").join(hot.hint("merge"), F.col("key") == F.col("hot_key"), "left_anti")
    mine = cold.select(F.col("key").alias("o_key"), F.col("h1").alias("o_h1"))
    pairs = cold.join(mine.hint("merge"), F.col("key") == F.col("o_key")).filter("h1 < o_h1")
    pairs = pairs.groupBy(F.col("h1").alias("a"), F.col("o_h1").alias("b")).agg(F.lit(1).alias("one")).select("a", "b")
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("h1").alias(end), F.col("line").alias(f"{end}_line"), F.col("first").alias(f"{end}_first")).hint("merge"), end)
    near = verified(pairs, p)
    late = stored(near.select(F.when(F.col("a_first") < F.col("b_first"), F.col("b")).otherwise(F.col("a")).alias("late")).distinct(), f"{where}/late-cold")
    if hot.isEmpty():
        return late

    # most lines of a hot key are near its earliest line; one comparison for each tells
    many = rows.select("key", "h1").join(hot.hint("merge"), F.col("key") == F.col("hot_key")).drop("hot_key")
    many = many.join(known.withColumnRenamed("h1", "k_h1").hint("merge"), F.col("h1") == F.col("k_h1")).drop("k_h1")
    many = many.join(late.hint("merge"), F.col("h1") == F.col("late"), "left").withColumn("open", F.col("late").isNull()).drop("late")
    many = stored(many, f"{where}/hot-lines")
    earliest = many.groupBy(F.col("key").alias("e_key")).agg(F.min(F.struct("first", "line")).alias("e"))
    near = many.filter("open").join(earliest.hint("merge"), F.col("key") == F.col("e_key")).filter(F.col("e.first") < F.col("first"))
    late = stored(late.union(near.filter(_near(F.col("line"), F.col("e.line"), p)).select("h1")).distinct(), f"{where}/late-hot")

    # lines that are known to go need no more partners, but may be partners of others
    hot_keys = many.groupBy(F.col("h1").alias("x_h1")).agg(F.collect_set("key").alias("keys"))  # no more than a line has
    many = many.drop("open").join(late.hint("merge"), F.col("h1") == F.col("late"), "left").join(hot_keys.hint("merge"), F.col("h1") == F.col("x_h1"))
    lower = F.filter("keys", lambda k: k < F.col("key")).alias("lower")
    x = F.struct("first", "line", "h1", F.col("late").isNull().alias("open"), lower, _letters(F.col("line")).alias("letters"))
    many = many.select("key", "parts", F.pmod(F.xxhash64("h1"), F.col("parts")).cast("int").alias("part"), x.alias("x"))
    blocks = stored(many.groupBy("key", "parts", "part").agg(F.sort_array(F.collect_list("x")).alias("xs")), f"{where}/blocks")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = blocks.select("key", F.filter("xs", lambda x: x["open"]).alias("xs"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to")).filter("size(xs) > 0")
    other = blocks.select(F.col("key").alias("o_key"), F.col("part").alias("o_part"), F.col("xs").alias("ys"))
    both = mine.repartition(n, "key", "to").join(other.repartition(n, "o_key", "o_part").hint("merge"), (F.col("key") == F.col("o_key")) & (F.col("to") == F.col("o_part")))

    def partner(x: Column, y: Column) -> Column:
        # two lines that share several hot keys meet under the least of them alone
        return (y["first"] < x["first"]) & (_unlike(x["letters"], y["letters"]) <= 2 * p.most) & ~F.arrays_overlap(x["lower"], y["lower"]) & _near(x["line"], y["line"], p)

    found = F.filter("xs", lambda x: F.exists("ys", lambda y: partner(x, y)))
    return late.union(both.select(F.explode(F.transform(found, lambda x: x["h1"])).alias("late"))).distinct()


#: Disjoint groups of letters, each of about as many characters of a text in Latin letters.
GROUPS = ("et", "an", "oi", "rs", "hl", "dc", "um ")


def _letters(line: Column) -> Column:
    """How many characters of each group a line has."""
    return F.struct(*[(F.length(line) - F.length(F.translate(line, g, ""))).alias(f"g{k}") for k, g in enumerate(GROUPS)])


def _unlike(a: Column, b: Column) -> Column:
    """The sum of differences of these numbers: an edit changes it by two at most."""
    return sum((F.abs(a[f"g{k}"] - b[f"g{k}"]) for k in range(1, len(GROUPS))), F.abs(a["g0"] - b["g0"]))


def repeated(docs: DataFrame, p: Lines, where: str, id_col: str, text_col: str) -> DataFrame:
    """doc and the numbers of its lines that go."""
    lines = split_lines(docs, id_col, text_col)
    spots = stored(lines.select("doc", "no", "h1", "h2"), f"{where}/lines")
    groups = stored(
        spots.groupBy("h1", "h2").agg(F.min(F.struct("doc", "no")).alias("first"), F.max(F.struct("doc", "no")).alias("last")), f"{where}/groups"
    )
    later = stored(later_lines(lines.select("h1", "line"), groups, p, where), f"{where}/late")
    bad = groups.join(later.hint("merge"), F.col("h1") == F.col("late"), "left").filter("late is not null or first < last")
    bad = stored(bad.select("h1", "h2", "first", F.col("late").isNotNull().alias("near")), f"{where}/repeats").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first", "near")
    gone = spots.join(bad.hint("merge"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")))
    gone = gone.filter(F.col("near") | (F.struct("doc", "no") != F.col("first")))
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set("no")).alias("numbers"))


def _kept(text: Column, numbers: Column) -> Column:
    """The text without the lines of these sorted numbers, in time linear in the text."""
    parts = F.struct(F.split(text, "\n").alias("p"), numbers.alias("g"))
    from_ = lambda v, k: F.when(k == 0, 0).otherwise(F.get(v["g"], k - 1) + 1)
    to = lambda v, k: F.when(k == F.size(v["g"]), F.size(v["p"])).otherwise(F.get(v["g"], k))
    # the stretches between the numbers
    stretches = lambda v: F.flatten(F.transform(F.sequence(F.lit(0), F.size(v["g"])), lambda k: F.slice(v["p"], from_(v, k) + 1, to(v, k) - from_(v, k))))
    return F.array_join(F.element_at(F.transform(F.array(parts), stretches), 1), "\n")


def dedup_lines(docs: DataFrame, p: Lines = Lines(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the kept text in ``text_col``, and n_lines and n_removed."""
    gone_doc, numbers = fresh("gone_doc", docs.columns), fresh("gone_numbers", docs.columns)
    gone = repeated(docs, p, shared_dir(docs.sparkSession), id_col, text_col).withColumnsRenamed({"doc": gone_doc, "numbers": numbers})
    joined = docs.join(gone, F.col(id_col) == F.col(gone_doc), "left")
    ends = F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(ends + 1)
    return joined.select(
        *[F.col(c) if c != text_col else F.when(F.col(numbers).isNull(), F.col(c)).otherwise(_kept(F.col(c), F.col(numbers))).alias(c) for c in docs.columns],
        n.cast("long").alias(fresh("n_lines", docs.columns)),
        F.when(F.col(numbers).isNull() | F.col(text_col).isNull(), 0).otherwise(F.size(numbers)).cast("long").alias(fresh("n_removed", docs.columns)),
    )


def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_dedup_stage(spark, docs, sf_dir):
    """Pipeline stage: repeated lines go; every document stays, with its new text and length."""
    out = dedup_lines(docs, STAGE)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


QUERIES = {"op7_line_dedup": op7_line_dedup}
#: DuckDB's distance counts bytes: letters beyond ASCII (of which there are few) become one byte each.
ORACLES = {
    "op7_line_dedup": """
WITH l AS (SELECT doc_id, unnest(range(len(parts))) AS no, unnest(parts) AS whole FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
t AS (SELECT doc_id, no, whole, trim(whole, ' ') AS line FROM l),
x AS (SELECT string_agg(c, '' ORDER BY c) AS letters FROM (SELECT DISTINCT unnest(regexp_extract_all(line, '[^\x00-\x7F]')) AS c FROM t)),
g AS (SELECT line, min(struct_pack(d := doc_id, n := no)) AS first_at, length(line) AS n,
    translate(line, any_value(letters), (SELECT string_agg(chr(CAST(k AS INTEGER)), '' ORDER BY k) FROM unnest(range(1, 32)) r(k) WHERE k NOT BETWEEN 9 AND 13)) AS coded
    FROM t, x WHERE line <> '' GROUP BY line),
p AS (SELECT g.*, least(3, (n + 10) // 20) AS edits FROM g),
n AS (SELECT DISTINCT b.line FROM p a JOIN p b ON a.first_at < b.first_at AND a.n BETWEEN b.n - 3 AND b.n + 3
    WHERE least(a.edits, b.edits) > 0 AND abs(a.n - b.n) <= least(a.edits, b.edits) AND levenshtein(a.coded, b.coded) <= least(a.edits, b.edits)),
j AS (SELECT t.doc_id, t.no, t.whole, t.line <> '' AND (n.line IS NOT NULL OR struct_pack(d := t.doc_id, n := t.no) <> g.first_at) AS gone
    FROM t LEFT JOIN g ON t.line = g.line LEFT JOIN n ON t.line = n.line)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
    sha256(coalesce(string_agg(whole, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""
}
