"""Text and set functions as Column expressions, without Python in the executors.

Missing text is the empty string in records; every function here takes null as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

#: Words that are never content terms: fixed values.
STOPWORDS = tuple(
    """a an and are as at be been being but by can could did do does for from had has have how if in
    into is it its may might must no not of on or our shall should so such than that the their them
    then there these they this those to under up use used using was we were what when where which
    while who will with within without would you your yours via per each any all also more most
    other only own same very just both few many much new one two three etc e.g i.e""".split()
)


def _col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), where value is computed once: inside a lambda, an outer expression is computed for every element."""
    return F.transform(F.array(value), body)[0]


def text_of(x: ColumnOrName) -> Column:
    """The text, or the empty string."""
    return F.coalesce(_col(x), F.lit(""))


def collapse(x: ColumnOrName) -> Column:
    """Lower case, with every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text_of(x)), r"\s+", " "))


def tokens(x: ColumnOrName) -> Column:
    """The words of the lower-cased text, in order."""
    return F.filter(F.split(F.lower(text_of(x)), r"\s+"), lambda w: w != "")


def token_set(x: ColumnOrName) -> Column:
    return F.array_distinct(tokens(x))


def shingles(x: ColumnOrName, size: int = 5) -> Column:
    """Distinct word shingles; a shorter text has one of all its words, an empty text the empty shingle."""

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " ")))

    return let(tokens(x), cut)


def normalise(x: ColumnOrName) -> Column:
    """Lower-case words of letters, digits and +#. without full stops at their ends, between single blanks and with one on
    both sides, so that phrases match as whole words."""
    words = F.split(F.regexp_replace(F.lower(text_of(x)), r"[^\p{L}\p{N}+#.]", " "), " ")
    kept = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"\.+$", "")), lambda w: w != "")
    return F.concat(F.lit(" "), F.array_join(kept, " "), F.lit(" "))


def phrase_count(haystack: Column, phrase: Column) -> Column:
    """How often a phrase stands in a normalised text; hits do not overlap, so neighbours that share a blank count once."""
    padded = F.concat(F.lit(" "), phrase, F.lit(" "))
    return ((F.length(haystack) - F.length(F.replace(haystack, padded, F.lit("")))) / F.length(padded)).cast("long")


def strip_name(x: ColumnOrName, name: ColumnOrName) -> Column:
    """The text without the name, with its hyphens or underscores as blanks, or in lower case: each gives a blank.

    Variants are tried in a fixed order, the name as written first."""
    out, name = text_of(x), text_of(name)
    for variant in (name, F.replace(name, F.lit("-"), F.lit(" ")), F.replace(name, F.lit("_"), F.lit(" "))):
        for form in (variant, F.lower(variant)):
            out = F.when(form == "", out).otherwise(F.replace(out, form, F.lit(" ")))
    return out


def terms(x: ColumnOrName, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Content words (three characters or more, no stop word, not all digits) and pairs of neighbours that are both content."""
    def content(w: Column) -> Column:
        return (F.length(w) >= 3) & ~w.isin(*stopwords) & ~w.rlike(r"^\p{N}+$")

    def found(own: Column) -> Column:
        """own: struct<w, c> of each word and whether it is content."""
        pairs = F.zip_with(own, F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))), lambda a, b: F.when(a["c"] & b["c"], F.concat_ws(" ", a["w"], b["w"])))
        singles = F.transform(F.filter(own, lambda x: x["c"]), lambda x: x["w"])
        return F.array_union(singles, F.filter(pairs, lambda p: p.isNotNull()))

    words = F.filter(F.split(F.trim(normalise(x)), " "), lambda w: w != "")
    return let(F.transform(words, lambda w: F.struct(w.alias("w"), content(w).alias("c"))), found)


def chunks(x: ColumnOrName, size: int = 150) -> Column:
    """Windows of so many words, without overlap; an empty text has none."""

    def cut(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))

    return let(F.filter(F.split(text_of(x), r"\s+"), lambda w: w != ""), cut)


#: What ends a line, as in Python's splitlines: fixed values.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def lines(x: ColumnOrName) -> Column:
    """The lines of a text; a line end at the very end starts no further line, and an empty text has none."""
    parts = F.split(text_of(x), LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def structure_features(x: ColumnOrName) -> Column:
    """array<double>: log1p(words), heading lines, fences in pairs, bullet lines, numbered lines, question marks.

    A numbered line has a digit and a full stop at its start, and a second full stop or nothing after it."""
    text = text_of(x)
    rows = F.transform(lines(text), lambda line: F.ltrim(line))
    count = lambda of: F.size(F.filter(rows, of)).cast("double")
    hits = lambda s: ((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.array(
        F.log1p(words.cast("double")),
        count(lambda r: r.startswith("#")),
        F.floor(hits("```") / 2).cast("double"),
        count(lambda r: r.startswith("- ") | r.startswith("* ")),
        count(lambda r: r.rlike(r"^[0-9]\.(\.|$)")),
        hits("?").cast("double"),
    )


def file_stem(path: ColumnOrName) -> Column:
    """The last part of a path in lower case, without its last suffix; a leading full stop starts no suffix."""
    name = F.regexp_extract(text_of(path), r"([^/]+)/*$", 1)
    return F.lower(F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1"))


def clean_id(source: ColumnOrName, name: ColumnOrName) -> Column:
    """source/name with blanks, brackets, colons, commas, semicolons and apostrophes as underscores."""
    return F.translate(F.concat(text_of(source), F.lit("/"), text_of(name)), " ():;,'[]", "_________")


def short_hash(*parts: ColumnOrName, length: int = 16, sep: str = "|") -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts, joined."""
    return F.substring(F.sha2(F.concat_ws(sep, *[text_of(p) for p in parts]), 256), 1, length)


def probe_hash(prompt: ColumnOrName, planted: ColumnOrName) -> Column:
    """16 digits over prompt and planted issue; a missing issue counts as the word None."""
    return F.substring(F.sha2(F.concat(text_of(prompt), F.lit("\n"), F.coalesce(_col(planted), F.lit("None"))), 256), 1, 16)


def clean_set(items: ColumnOrName) -> Column:
    """Trimmed lower-case items, without blanks and repeats."""
    trimmed = F.transform(F.coalesce(_col(items), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(trimmed, lambda x: x != ""))


def mode_set(inputs: ColumnOrName, outputs: ColumnOrName) -> Column:
    return F.array_union(clean_set(inputs), clean_set(outputs))


# distances of two sets, with their conventions for empty ones


def jaccard_distance(a: Column, b: Column) -> Column:
    """Both empty: 0; one empty: 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def combine(blocks: dict[str, Column], weights: dict[str, float], empty: float) -> Column:
    """The weighted mean of the blocks that are not null; a missing weight is 1; `empty` if nothing has weight."""
    num = den = F.lit(0.0)
    for name, d in blocks.items():
        w = float(weights.get(name, 1.0))
        num = num + F.when(d.isNotNull(), w * d).otherwise(0.0)
        den = den + F.when(d.isNotNull(), w).otherwise(0.0)
    return F.when(den > 0, num / den).otherwise(F.lit(empty))


def classify_lineage(lineage: Column, functional: Column, lineage_least: float = 0.7, functional_least: float = 0.7) -> Column:
    return F.when(lineage >= lineage_least, "homologous").when(functional >= functional_least, "convergent").otherwise("unclassified")


def cosine_distance(u: Column, v: Column) -> Column:
    """Of unit vectors, within 0 and 1; null if either is missing."""
    dot = F.aggregate(F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(u.isNotNull() & v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - dot)))


def unit(v: ColumnOrName) -> Column:
    """The vector at length 1; a zero vector is missing."""
    v = _col(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return let(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))


def wilson(passed: Column, n: Column, z: float = 1.96) -> Column:
    """struct<low, high> of the Wilson interval; of no runs, 0 and 1."""
    p, n = passed / n, n.cast("double")
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low = F.when(n > 0, F.greatest(F.lit(0.0), middle - half)).otherwise(0.0)
    high = F.when(n > 0, F.least(F.lit(1.0), middle + half)).otherwise(1.0)
    return F.struct(low.alias("low"), high.alias("high"))
