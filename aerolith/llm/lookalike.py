"""Visually identical text with different characters, brought to one form.

Each text is decomposed canonically; signs that look like another are mapped to it, all single
blanks to the space, and signs without width are dropped. Which letters look alike, in any script,
is read from the table of confusable signs that the Unicode library of the JVM carries, under rules
that keep apart what a reader tells apart; a short list settles what that table leaves open. The mapped values are grouped in SQL under
an accent-sensitive and case-sensitive Unicode collation, which also equates what the map leaves to
it (the order of combining marks, other ignorable signs). Each class gets one canonical member,
which is joined back to its documents.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.runtime import HOT_SHARE, salted_join, written

#: So many candidate ids (of 24 bytes) may be broadcast.
FEW = 200_000

# Signs that have the shape of a basic Latin letter, by that letter.
SAME_SHAPE = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "СᏟⅭϹꓚ", "D": "ⅮᎠꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻꓧ", "I": "ΙІӀⅠꓲ", "J": "ЈᎫꓙͿ",
    "K": "ΚКᏦꓗ", "L": "ᏞⅬꓡ", "M": "ΜМᎷⅯꓟ", "N": "Νꓠ", "O": "ΟОՕꓳ", "P": "ΡРᏢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔ",
    "U": "Սꓴ", "V": "ѴᏙⅤꓦ", "W": "ԜᎳꓪ", "X": "ΧХⅩꓫ", "Y": "ΥҮꓬ", "Z": "ΖᏃꓜ",
    "a": "аɑ", "b": "Ь", "c": "сϲⅽᴄ", "d": "ԁⅾ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іⅰ", "j": "јϳ", "l": "ӏⅼ", "m": "ⅿ", "n": "ո",
    "o": "οоօᴏ", "p": "рⲣ", "q": "ԛգ", "s": "ѕꜱ", "u": "սᴜ", "v": "νѵⅴᴠ", "w": "ԝᴡ", "x": "хⅹ", "y": "уү", "z": "ᴢ",
    "μ": "µ",
}
# Code points of single blanks, and of signs without width.
BLANKS = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
NO_WIDTH = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]


def shape_map() -> dict[str, str]:
    """Sign -> sign, or "" for none: same shapes, blanks, no width, and full-width or half-width forms.

    The forms of other width follow the rule of their block: U+FF01 to U+FF5E lie 0xFEE0 above ASCII,
    and the rest have compatibility decompositions marked wide or narrow.
    """
    import unicodedata

    out = {sign: letter for letter, signs in SAME_SHAPE.items() for sign in signs}
    out |= {chr(b): " " for b in BLANKS} | {chr(z): "" for z in NO_WIDTH}
    for cp in range(0xFF01, 0xFFEF):
        kind, _, plain = unicodedata.decomposition(chr(cp)).partition(" ")
        if kind in ("<wide>", "<narrow>"):
            sign = chr(int(plain, 16))
            out[chr(cp)] = out.get(sign, sign)
    return out


#: Where the table of confusable signs is read for letters: all but the ideographs and Hangul syllables.
LETTERS = [(0x00A1, 0x3400), (0xA000, 0xAC00), (0xFB00, 0xFE00), (0xFE70, 0xFEFF), (0x10000, 0x12000), (0x16A00, 0x17000), (0x1D000, 0x1F000)]
# The Greek small letters whose shape is a Latin letter's; the table is looser on the others.
GREEK_SMALL_ALIKE = "ον"


def letter_map() -> dict[str, str]:
    """Letter -> the letter of its shape, by rule from the Unicode library's table of confusable signs.

    A letter counts with the one letter that the table reduces it to, if both are of one case or of a
    script without case. Left out: signs with a compatibility form (raised, circled, bold and the like look
    different), modifier letters, letters with a canonical decomposition (texts are decomposed before),
    and Greek small letters but for GREEK_SMALL_ALIKE. The table does not tell I from l, so capitals
    go to I, small letters to l, and letters without case to neither; what it reduces to "rn" is an m.
    """
    import unicodedata

    kinds = {"Lu": "upper", "Ll": "lower", "Lo": "any", "Nl": "any"}
    signs = [chr(c) for low, high in LETTERS for c in range(low, high) if unicodedata.category(chr(c)) in kinds and not unicodedata.decomposition(chr(c))]
    signs = [c for c in signs if not ("\u03b1" <= c <= "\u03c9" and c not in GREEK_SMALL_ALIKE)]
    checker = SparkContext._active_spark_context._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    out = {}
    for sign, to in zip(signs, checker.getSkeleton("\n".join(signs)).split("\n")):
        mine = kinds[unicodedata.category(sign)]
        if to == "l":
            to = {"upper": "I", "lower": "l"}.get(mine, sign)
        elif to == "rn":
            to = "m"
        if to == sign or len(to) != 1:
            continue
        other = kinds.get(unicodedata.category(to))
        if other and (other == mine or "any" in (other, mine)):
            out[sign] = to
    return out


def look_map() -> dict[str, str]:
    """``letter_map`` and ``shape_map``, which goes before; what a letter goes to is itself in its final form."""
    shapes = shape_map()
    letters = {c: shapes.get(to, to) for c, to in letter_map().items() if c not in shapes}
    return letters | {c: letters.get(to, to) for c, to in shapes.items()}


def _decomposed(text: Column) -> Column:
    """Canonical decomposition by the JVM's own Unicode library, called by name; it takes no null."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(False))


def mapped(text: Column) -> Column:
    """``text`` decomposed canonically, then every sign of look_map() replaced; null stays null."""
    table = look_map()
    kept = [c for c, to in table.items() if to]
    gone = [c for c, to in table.items() if not to]
    plain = _decomposed(F.coalesce(text, F.lit("")))
    look = F.translate(plain, "".join(kept + gone), "".join(table[c] for c in kept))
    # Marks that a dropped sign had kept apart come into canonical order; other texts are in it.
    look = F.when(F.length(look) < F.length(plain), _decomposed(look)).otherwise(look)
    return F.when(text.isNotNull(), look)


def _collation_key(text: Column) -> Column:
    """The sort key of ``text`` under UNICODE, equal exactly for equal texts; no SQL function gives it, and hash functions ignore the collation."""
    jvm = SparkContext._active_spark_context._jvm
    expr = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return Column(expr.column(jvm.org.apache.spark.sql.catalyst.expressions.CollationKey(expr.expression(F.collate(text, "UNICODE")._jc))))


def _visible(look: Column) -> Column:
    """Does more than blanks and ignorable signs stand in ``look``; a visible ASCII sign answers at once."""
    bare = F.collate(F.regexp_replace(look, r"\s+", ""), "UNICODE")
    return F.when(look.rlike("[!-~]"), True).otherwise(bare != F.collate(F.lit(""), "UNICODE"))


def lookalikes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(documents, classes) of the texts that look like another text without being the same characters.

    documents: (doc_id, raw) of every document with a visible text, ``raw`` a 128-bit print of its
    own characters. classes: (raw, class_id, canonical_id), one row per different text of a class;
    a class has two at least. ``class_id`` is the smallest doc_id of the class and ``canonical_id``
    its canonical member: of the texts with the fewest signs outside ASCII the smallest doc_id.

    Null, empty and blank texts (also of signs without width or ignorable signs only) and rows without id are left
    out. Exact copies share a raw print and count once in a class. Other columns are not read. An
    empty table gives two empty tables.

    Documents are reduced to one row per raw text by a partial aggregate before anything is grouped
    by look, so copies that are a third of all rows weigh no more than one text, and only texts that
    share their collation hash with another are grouped whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("look", mapped(F.col("text"))).where(_visible(F.col("look")))
    prints = rows.select("doc_id", F.unhex(F.md5("text")).alias("raw"), F.xxhash64(_collation_key(F.col("look"))).alias("hash"))
    prints = written(prints, "look-prints")
    raws = prints.groupBy("hash", "raw").agg(F.min("doc_id").alias("first_id"))
    crowded = raws.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    wanted = raws.join(crowded, "hash", "left_semi").select("first_id", "raw")

    # Whole texts of the candidates only, one document per raw text, grouped under the collation. While the
    # candidates are few, which is checked, their ids go to the texts; else the texts are shuffled by id once.
    wanted = written(wanted, "look-candidates")
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(doc_id).alias("first_id"), F.col(text).alias("text"))
    cand = texts.join(wanted, "first_id").where(F.unhex(F.md5("text")) == F.col("raw")).dropDuplicates(["raw"])
    cand = cand.select("first_id", "raw", mapped(F.col("text")).alias("look"), F.length(F.regexp_replace("text", r"[\x00-\x7F]+", "")).alias("odd"))
    classes = spark.sql(
        """SELECT min(first_id) AS class_id, min_by(first_id, struct(odd, first_id)) AS canonical_id, collect_set(raw) AS raws
        FROM {cand} GROUP BY collate(look, 'UNICODE') HAVING count(DISTINCT raw) > 1""",
        cand=cand,
    )
    return prints.select("doc_id", "raw"), written(classes.select(F.explode("raws").alias("raw"), "class_id", "canonical_id"), "look-classes")


def _hot(documents: DataFrame) -> list:
    n = documents.count()
    counts = documents.groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.where(F.col("n") * HOT_SHARE > F.lit(n)).select("raw").collect()] if n > 100_000 else []


def canonical(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, canonical_id) of every document of ``documents``; alone in its look it is its own."""
    joined = salted_join(documents, classes.select("raw", "canonical_id"), "raw", F.col("doc_id"), _hot(documents), "left")
    return joined.select("doc_id", F.coalesce("canonical_id", "doc_id").alias("canonical_id"))


def pairs(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: all pairs of a class whose texts are different characters.

    Different texts are paired first, then each is replaced by its documents, so the work is that of
    the result: exact copies are never compared with each other.
    """
    a = classes.select("class_id", F.col("raw").alias("raw_a"))
    b = classes.select("class_id", F.col("raw").alias("raw_b"))
    both = a.join(b, "class_id").where("raw_a < raw_b").select("raw_a", "raw_b")
    mine = documents.join(classes.select("raw"), "raw", "left_semi")
    hot = _hot(documents)
    left = salted_join(mine.select(F.col("raw").alias("raw_a"), F.col("doc_id").alias("a")), both, "raw_a", F.col("a"), hot)
    done = salted_join(mine.select(F.col("raw").alias("raw_b"), F.col("doc_id").alias("b")), left.select("a", "raw_b"), "raw_b", F.col("b"), hot)
    return done.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
