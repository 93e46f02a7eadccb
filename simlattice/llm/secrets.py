"""Secret scans in SQL functions only.

Base patterns give spans by kind. Sliding-window Shannon entropy adds spans of kind entropy: candidate strings (long runs of
key characters) are taken window by window, the counts of the window's characters change by the one that leaves and the one
that enters, and a class of characters has its own threshold. An allow-list suppresses candidates that are not secrets.
Places are code points, end exclusive. They follow from the pieces between matches, since SQL gives matches without places.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A text without this has no assign span: the same with at least 8 characters after it.
ASSIGN_ANY = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""
#: Runs that are long enough: a maximal run matches as a whole or not at all, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character that a window must reach, by class: digits and a-f only, or any key characters.
LEAST_HEX, LEAST_ANY = 2.95, 3.62
#: Candidates that are no secrets, whole or by a part: fixed values.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # a UUID
    r"(?i)example|placeholder|changeme|lorem|xxxx|redacted",
    r"(?i)0123456789|abcdefghijkl|qwertyuiop",
    r"^[0-9+/_=-]+$",  # numbers and rules
    r"^[A-Za-z+/_=-]+$",  # words, with or without joints
    r"//|/[^/]*/[^/]*/",  # URLs and paths
)
#: Of them, the one that a run of key characters may meet by chance, since / is one of them.
PATH = ALLOWED[-1]
#: A piece of a path that is words and numbers with joints between.
WORDS = r"^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[+_=-]+(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]++))++$"
_PLACE = "array<struct<start:int,kind:int,end:int>>"


def _places(text: Column, pattern: str, kind: int, group: int | None = None, least: int = 0) -> Column:
    """array<struct<start, kind, end, hit>> of the pattern's leftmost matches whose group has the least length.

    The split's pieces and the matches alternate, so a running sum of their lengths gives the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = hits if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # the pieces are one more than the matches
    steps = F.zip_with(F.zip_with(hits, part, lambda h, p: F.struct(h.alias("hit"), p.alias("part"))), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda x, gap: F.struct(F.length(gap).alias("gap"), x["hit"].alias("hit"), F.length(x["part"]).alias("n")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,hit:string>>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        start, end = s["at"] + x["gap"], s["at"] + x["gap"] + F.length(x["hit"])
        new = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.when(x["n"] >= least, F.concat(s["out"], new)).otherwise(s["out"]).alias("out"))

    return F.aggregate(steps, none, add, lambda s: s["out"])


def _plain(places: Column) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


#: Counts of a window's characters: six bits each, ten to a long, for characters from + to z.
_FIRST, _BITS, _EACH, _LONGS = ord("+"), 6, 10, 8


def _highest(s: Column, window: int) -> Column:
    """The highest Shannon entropy, in bits a character, of s's windows, in one pass over s; null if s is shorter than a window.

    The state carries the count of every character in the window, and the sum of n*log2(n) over them. A step reads and changes two counts,
    of the character that enters and the one that leaves, and the sum by what these two change. s is of key characters, and window at most 62."""
    weight = [n * math.log2(n) if n else 0.0 for n in range(window + 3)]
    enters = F.array(*[F.lit(weight[n + 1] - weight[n]) for n in range(window + 2)])
    leaves = F.array(*[F.lit(weight[max(n - 1, 0)] - weight[n]) for n in range(window + 2)])
    mask = (1 << _BITS) - 1

    def place(c: Column) -> Column:
        k = F.ascii(c) - _FIRST
        shift = k % _EACH * _BITS
        return F.struct((k / _EACH).cast("int").alias("at"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("one"))

    places = F.transform(F.split(s, ""), place)
    nobody = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("one"))
    before = F.concat(F.array_repeat(nobody, window), places)
    moves = F.zip_with(places, F.slice(before, F.lit(1), F.length(s)), lambda x, y: F.struct(x.alias("new"), y.alias("old")))

    def count(state: Column, x: Column) -> Column:
        word = F.lit(0).cast("long")
        for j in reversed(range(_LONGS)):
            word = F.when(x["at"] == j, state[f"n{j}"]).otherwise(word)
        return F.call_function("shiftright", word, x["shift"]).bitwiseAND(mask).cast("int")

    def slide(state: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        same = (new["at"] == old["at"]) & (new["shift"] == old["shift"])
        change = F.element_at(enters, count(state, new) + 1) + F.when(old["at"] >= 0, F.element_at(leaves, count(state, old) + 1)).otherwise(0.0)
        total = F.when(same, state["sum"]).otherwise(state["sum"] + change)
        counts = [(state[f"n{j}"] + F.when(new["at"] == j, new["one"]).otherwise(0) - F.when(old["at"] == j, old["one"]).otherwise(0)).alias(f"n{j}") for j in range(_LONGS)]
        return F.struct(*counts, total.alias("sum"), (state["seen"] + 1).alias("seen"), F.when(state["seen"] + 1 >= window, F.least(state["low"], total)).alias("low"))

    zero = F.lit(0).cast("long")
    start = F.struct(*[zero.alias(f"n{j}") for j in range(_LONGS)], F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), F.lit(None).cast("double").alias("low"))
    return F.lit(math.log2(window)) - F.aggregate(moves, start, slide, lambda state: state["low"]) / window


def find_secrets(docs: DataFrame, text_col: str = "text", window: int = WINDOW, pieces: bool = False) -> DataFrame:
    """Adds secrets, array<struct<start, kind, end>> by start, then kind (0 to 3, as in KINDS), over every whole text.

    A null or empty text has none. Rows are independent, so ties and repeated rows need no rule. Other columns pass through;
    columns named secrets or beginning with _x_ are replaced. An entropy span is a whole candidate of which a window reaches its class's bits, unless
    a base span overlaps it or the allow-list has it.

    With pieces, a candidate that only looks like a path is kept if one of its pieces between slashes would be a secret for itself
    and is not words.
    """
    docs = docs.drop("secrets", *[c for c in docs.columns if c.startswith("_x_")])
    columns = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(_PLACE)
    df = docs.withColumn("_x_text", text)
    t = F.col("_x_text")
    df = df.withColumn(
        "_x_base",
        F.concat(
            F.when(t.rlike(ASSIGN_ANY), _plain(_places(t, ASSIGN, 0, 2, 8))).otherwise(none),
            F.when(t.contains("AKIA"), _plain(_places(t, ACCESS, 1))).otherwise(none),
            F.when(t.rlike(HEX), _plain(_places(t, HEX, 2))).otherwise(none),
        ),
    )

    def mixed(hit: Column, rules: tuple[str, ...]) -> Column:
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & ~functools.reduce(operator.or_, [hit.rlike(pattern) for pattern in rules])

    rules = tuple(p for p in ALLOWED if p != PATH) if pieces else ALLOWED
    found = F.filter(_places(t, CANDIDATE, 3), lambda x: mixed(x["hit"], rules))
    free = F.filter(found, lambda x: ~F.exists("_x_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))

    def high(hit: Column) -> Column:
        return _highest(hit, window) >= F.when(hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), LEAST_HEX).otherwise(LEAST_ANY)

    def secret(hit: Column) -> Column:
        if not pieces:
            return high(hit)
        own = F.exists(F.split(hit, "/"), lambda p: F.when(F.length(p) >= window, mixed(p, (*rules, WORDS)) & high(p)).otherwise(False))
        return F.when(hit.rlike(PATH), own).otherwise(high(hit))

    added = _plain(F.filter(free, lambda x: secret(x["hit"])))
    df = df.withColumn("_x_added", F.when(t.rlike(r"[A-Za-z0-9+/_=-]{20}"), added).otherwise(none))
    return df.select(*columns, F.array_sort(F.concat("_x_base", "_x_added")).alias("secrets"))


def digest(places: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(places, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with each found span replaced by mark; overlapping spans give one mark. Null texts stay null."""
    found = find_secrets(docs, text_col, pieces=True)
    t = F.col(text_col)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(s: Column, x: Column) -> Column:
        gap = F.substr(t, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        out = F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(s["out"], gap, F.lit(mark)))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("secrets", state, add, lambda s: F.concat(s["out"], F.substr(t, s["at"] + 1, F.length(t))))
    return found.withColumn(text_col, F.when(F.size("secrets") > 0, clean).otherwise(t))
