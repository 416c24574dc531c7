"""One form for texts that look the same (problem 1).

Each distinct value is mapped to a *skeleton*: characters that are not drawn are left out, all
spaces become one kind, width and presentation variants and look-alike letters of other scripts
become one character. Which letters look alike is Unicode's confusables data, as ICU in the JVM holds it
(version 16.0 in Spark 4.1's): letters of one prototype and one case are one. Beside it stand the few lines of
``LOOK_ALIKES``, for signs and where the data is silent, and ``VISIBLE``, where it is too broad. Skeletons are grouped in SQL under Spark's accent- and case-sensitive Unicode
collation, which takes the codings of a mark for equal; every class gets a deterministic canonical
member (the shortest value, then the first by code point) that is joined back to all rows.

The collation's weights also treat a few visibly different strings as equal: digits of different
scripts, Thai and Lao vowels and their consonant in either order, some Hebrew and Quranic marks. An
exact check on just these characters keeps them apart.

Stays different: letter case, other or missing marks, raised, lowered, circled or bold letters and
digits, the number of inner spaces. Spaces at either end are not visible.

Defined results: a null text has a null form; an empty one, or one of undrawn characters and spaces
only, belongs to the class of the empty text. Copies get the same form; extra columns are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinequery.functions.characters import CODE_POINTS, undrawn

# Signs of one shape, and letters that go before the confusables data. The first of each line stands for all.
LOOK_ALIKES = """
lӏ
QԚ
ĐƉÐ
đ
-‐‑
·‧∙⋅
:∶
/∕⁄
,‚
.․
!ǃ
’ʼ
"""
# Letters that the data takes for others although a dot, bar, bowl or tail tells them apart.
VISIBLE = frozenset("ıɩɪιꙇꭵ𑣃ſẝƍσƽƼɣγꭚßβꞵᏰꟗɯѡгᴦⲅꭇꭈꮁЛЄƄᏏᏎᏮ")
#: Rows of one class in one group that a task pairs with each other at once, on average.
CLASS_ROWS = 20_000

#: Characters with a decomposition that is drawn like them, beside full, half-width and Arabic presentation forms.
_SAME_DRAWN = [(0x2E80, 0x2FDF), (0x2160, 0x217F), (0xFB00, 0xFB06), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0132, 0x0133), (0x3131, 0x318E), (0x2024, 0x2026), (0x203C, 0x203C), (0x2047, 0x2049), (0x2103, 0x2103), (0x2109, 0x2109), (0x00B5, 0x00B5)]
_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}

#: What the collation takes for equal although it looks different; compared character by character.
_KEPT_APART = r"[\p{IsThai}\p{IsLao}֑-ֽؐ-ؚۖ-ۭ]|[\p{Nd}&&[^0-9]]"


def _table() -> dict[int, str]:
    out: dict[int, str] = {}
    for code in CODE_POINTS:
        c = chr(code)
        tag = unicodedata.decomposition(c).partition(" ")[0]
        if undrawn(c):
            out[code] = ""
        elif unicodedata.category(c) == "Zs" or c in "\t\n\v\f\r\x85  ":
            out[code] = " "
        elif tag in _TAGS or tag == "<compat>" and any(a <= code <= b for a, b in _SAME_DRAWN):
            out[code] = unicodedata.normalize("NFKD", c)
    for line in LOOK_ALIKES.split():
        out.update((ord(c), line[0]) for c in line[1:])
    for code, to in out.items():  # a variant of a look-alike
        out[code] = "".join(out.get(ord(x), x) for x in to)
    return out


TABLE = _table()


@cache
def _confusable(jvm) -> dict[str, list[str]]:
    """Letters with case that have no decomposition, by prototype and case."""
    letters = [c for c in map(chr, CODE_POINTS) if unicodedata.category(c) in ("Lu", "Ll") and not unicodedata.decomposition(c) and c not in VISIBLE]
    # One call: line ends have no look-alikes, and letters without a decomposition are not moved past them.
    prototypes = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
    found: dict[str, list[str]] = {}
    for c, prototype in zip(letters, prototypes, strict=True):
        found.setdefault(prototype + unicodedata.category(c), []).append(c)
    return found


def look_table(spark: SparkSession) -> dict[int, str]:
    """``TABLE`` and the confusables data: what each character is drawn like. The ASCII letter stands for its class, else the first."""
    letters: dict[int, str] = {}
    for alike in _confusable(spark.sparkContext._jvm).values():
        for c in alike[1:]:
            if ord(c) not in TABLE:
                letters[ord(c)] = TABLE.get(ord(alike[0]), alike[0])
    variants = {code: "".join(letters.get(ord(x), x) for x in to) for code, to in TABLE.items()}
    return variants | letters


def skeleton(text: str | None, table: dict[int, str]) -> str | None:
    """Equal for texts that look the same, but for what the collation adds."""
    if text is None:
        return None
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(table)).strip(" ")


def _skeletons(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([skeleton(t, table) for t in batch.column(0).to_pylist()], pa.string())], ["text", "skeleton"])

    return run


def classes(texts: DataFrame) -> DataFrame:
    """(text, canonical, written, members) for each distinct non-null value of the one column of ``texts``.

    ``written``: whether a letter or digit is to be seen (some radicals and numerals are no letters, but look like ones).
    ``members``: different texts of the class.
    """
    column = texts.columns[0]
    spark, apart = texts.sparkSession, _KEPT_APART.replace("{", "{{").replace("}", "}}")
    values = texts.select(F.col(column).alias("text")).where("text is not null").distinct()
    drawn = values.mapInArrow(_skeletons(spark.sparkContext.broadcast(look_table(spark))), "text string, skeleton string")
    return spark.sql(
        f"""
        with mapped as (
            select text, skeleton rlike r'[\\p{{{{L}}}}\\p{{{{N}}}}]' as written, collate(skeleton, 'UNICODE') as look, array_join(regexp_extract_all(skeleton, r'{apart}', 0), '') as apart
            from {{drawn}}
        )
        select text, written, min(struct(char_length(text) as length, text)) over (partition by look, apart).text as canonical, count(*) over (partition by look, apart) as members from mapped
        """,
        drawn=drawn,
    )


def canonical_form(rows: DataFrame, text: str, into: str = "canonical") -> DataFrame:
    """``rows`` with the column ``into``: the canonical member of the class of ``text``."""
    if into in rows.columns:
        raise ValueError(f"column {into} exists")
    found = classes(rows.select(text)).select(F.col("text").alias("__value"), F.col("canonical").alias(into))
    return rows.join(found, F.col(text) == F.col("__value"), "left").drop("__value")


def same_looking_pairs(rows: DataFrame, key: str, group: Sequence[str], text: str, class_rows: int = CLASS_ROWS) -> DataFrame:
    """(key_a, key_b): rows of one group whose texts look the same but differ in their characters, key_a < key_b.

    Texts without letter or digit never count. Rows with a null key, group or text are left out.
    Copies of a row count once. Only classes with two or more different texts in a group are paired.
    """
    wanted = [key, *group, text]
    whole = F.lit(True)
    for c in wanted:
        whole &= F.col(c).isNotNull()
    kept = rows.select(*wanted).where(whole)
    found = classes(kept.select(text)).where("written and members > 1").select(F.col("text").alias("__value"), "canonical")
    by = [*group, "canonical"]
    lines = kept.join(found, F.col(text) == F.col("__value")).select(*by, key, text).distinct()
    # A class with many rows in one group is cut into slices; each slice meets the whole class, and no task more than that.
    sizes = lines.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min(text).alias("__lo"), F.max(text).alias("__hi")).where("__lo <> __hi")
    slices = F.ceil(F.col("__n") / class_rows).cast("int")
    several = lines.join(sizes.select(*by, slices.alias("__slices")), by)
    a = several.select(*by, F.pmod(F.xxhash64(key), F.col("__slices")).cast("int").alias("__slice"), F.col(key).alias("key_a"), F.col(text).alias("_text_a"))
    b = several.select(*by, F.explode(F.sequence(F.lit(0), F.col("__slices") - 1)).alias("__slice"), F.col(key).alias("key_b"), F.col(text).alias("_text_b"))
    return a.join(b, [*by, "__slice"]).where("key_a < key_b and _text_a <> _text_b").select("key_a", "key_b")
