"""Secret scans with multipart credential linking, in DataFrame functions only.

Some parts of a credential are secrets by themselves (the base kinds). Others are weak: an identifier, a bare random string
or an endpoint says little alone. Each weak part's scope, an interval around it, is joined with the intervals of the text's
other parts, and the part is reported only if complementary parts lie in it. All parts belong to one text, so the join stays
in the row and nothing is shuffled. The spans of a kind are disjoint and sorted, so the join is a binary search for each weak
part and kind, and offsets are prefix sums in log(n) rounds: a text costs its length and n * log(n) for its n parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import cut, own_prefix, pieces, scanned

#: Fixed patterns of the base kinds, in the order of their listing. Runs are maximal, so those of access and hex may ask for
#: their least lengths at once; an assignment that is too short still hides what it covers, so its value is measured afterwards.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
#: Weak parts: an identifier given by name, a bare string of forty base-64 characters, a service's address.
IDENTIFIER = r"(?<![A-Za-z0-9_])(?:client|account|user|access[_-]?key)[_-]?id[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}"
RANDOM = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?<![A-Za-z0-9_])https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/%-]*)?"

PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "random": RANDOM, "endpoint": ENDPOINT}
#: A quick test for each kind; texts that fail it hold no match that counts.
MAYBE = {
    "assign": r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8}", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}",
    "identifier": r"id[\"']?\x20*[:=]", "random": RANDOM, "endpoint": r"https?://",
}
BASE = ("assign", "access", "hex")
WEAK = ("identifier", "random", "endpoint")
KINDS = (*BASE, *WEAK)
#: What each kind is in a credential.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "random": "secret", "endpoint": "endpoint"}
#: Code points between parts that may belong together.
SCOPE = 300

SPANS = "array<struct<start:int,end:int>>"
REDACTED = "[REDACTED]"


def _with_places(docs: DataFrame, text: Column, p: str) -> DataFrame:
    """Adds the spans of each kind: the pieces that are left when the text is split at the matches tell where these lie.

    Each step is a projection of its own, so that a pattern is searched once for each use and arrays are made once.
    """
    found, gaps = {}, {}
    docs = docs.withColumns({f"{p}{kind}_maybe": text.rlike(test) for kind, test in MAYBE.items()})
    for kind, pattern in PATTERNS.items():
        some = F.col(f"{p}{kind}_maybe")
        found[f"{p}{kind}_own"] = F.when(some, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m)))
        gaps[f"{p}{kind}_gap"] = F.when(some, F.transform(F.split(text, pattern, -1), lambda x: F.length(x)))
    value = {f"{p}value": F.when(F.col(f"{p}assign_maybe"), F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_VALUE))}
    out = docs.withColumns(found | gaps | value)
    out = out.withColumns({f"{p}{k}_both": F.zip_with(f"{p}{k}_own", F.slice(f"{p}{k}_gap", F.lit(1), F.size(f"{p}{k}_own")), lambda n, g: n + g) for k in KINDS})
    out = out.withColumns({f"{p}{k}_end": scanned(f"{p}{k}_both", lambda x, y: x + y) for k in KINDS})
    spans = {f"{p}{k}": F.zip_with(f"{p}{k}_own", f"{p}{k}_end", lambda n, end: F.struct((end - n).alias("start"), end.alias("end"))) for k in KINDS}
    kept = F.filter(F.zip_with(spans[f"{p}assign"], f"{p}value", lambda s, v: F.struct(s.alias("span"), v.alias("keep"))), lambda x: x["keep"])
    spans[f"{p}assign"] = F.transform(kept, lambda x: x["span"])
    none = F.array().cast(SPANS)
    out = out.withColumns({k: F.coalesce(v, none) for k, v in spans.items()})
    return out.drop(f"{p}value", *(f"{p}{k}_{x}" for k in KINDS for x in ("maybe", "own", "gap", "both", "end")))


def _reached(spans: Column, low: Column, high: Column) -> Column:
    """Whether any of the sorted, disjoint spans reaches into (low, high): the last one that starts below high does, or none."""

    def halved(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        below = F.get(spans, middle)["start"] < high
        next_low, next_high = F.when(below, middle + 1).otherwise(at["low"]), F.when(below, at["high"]).otherwise(middle)
        return F.when(at["low"] >= at["high"], at).otherwise(F.struct(next_low.alias("low"), next_high.alias("high")))

    size = F.size(spans)
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(size)).cast("int"))
    found = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), size.alias("high")), halved, lambda at: at["low"])
    return (size > 0) & F.coalesce(F.get(spans, found - 1)["end"] > low, F.lit(False))


def find_secrets(docs: DataFrame, scope: int = SCOPE, text_col: str = "text") -> DataFrame:
    """Adds `secrets` to each row: base matches, and weak candidates next to complementary parts.

    Base kinds: assign (a password, secret, token or key that a name assigns, of 8 characters or more), access (AKIA and capitals
    or digits, 16 characters or more), hex (32 or more lower-case hexadecimal digits). Weak candidates lie apart from base
    matches: identifier (client, account, user or access-key id), random (40 base-64 characters), endpoint (a web address). Within
    `scope` code points, an identifier is reported if there is a secret, a random string if there is an identifier or an endpoint,
    an endpoint if there are an identifier and a secret. Complementary parts may be weak too.

    `secrets` is an array of (kind, start, end) in code points, end exclusive, by start and then kind in the order above; spans of
    different kinds may overlap. Null and empty texts have none. Repeated rows are treated alike. An empty table gives an empty
    result. All columns of the table stay, whatever their names; only a column called `secrets` is replaced.
    """
    p = own_prefix(docs.columns)
    out = _with_places(docs.withColumn(f"{p}text", F.coalesce(F.col(text_col), F.lit(""))), F.col(f"{p}text"), p)

    def any_of(kinds: Iterable[str], low: Column, high: Column) -> Column:
        return reduce(Column.__or__, (_reached(F.col(p + k), low, high) for k in kinds))

    def filtered(kind: str, test: Callable[[Column], Column]) -> Column:
        return F.when(F.size(p + kind) > 0, F.filter(p + kind, test)).otherwise(F.col(p + kind))

    def near(role: str, x: Column) -> Column:
        """Whether some part of a role reaches into the scope of x."""
        return any_of((k for k in KINDS if ROLES[k] == role), x["start"] - scope, x["end"] + scope)

    out = out.withColumns({f"{p}{k}": filtered(k, lambda x: ~any_of(BASE, x["start"], x["end"])) for k in WEAK})
    report = {"identifier": lambda x: near("secret", x), "random": lambda x: near("identifier", x) | near("endpoint", x), "endpoint": lambda x: near("identifier", x) & near("secret", x)}
    linked = {k: filtered(k, test) for k, test in report.items()}

    def placed(n: int, kind: str) -> Column:
        return F.transform(linked.get(kind, F.col(p + kind)), lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("place"), x["end"].alias("end")))

    kinds = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.transform(F.array_sort(F.concat(*(placed(n, k) for n, k in enumerate(KINDS)))), lambda x: F.struct(F.get(kinds, x["place"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return out.withColumn("secrets", ordered).drop(f"{p}text", *(f"{p}{k}" for k in KINDS))


def redact(docs: DataFrame, scope: int = SCOPE, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with each secret (overlapping ones together) replaced in the text.

    What is kept is cut out of short pieces of the text, so that a text with many secrets isn't counted through for each.
    """
    p = own_prefix(docs.columns)
    own = docs.withColumnRenamed("secrets", f"{p}own") if "secrets" in docs.columns else docs
    out = find_secrets(own, scope, text_col)
    some = F.size("secrets") > 0
    out = out.withColumn(f"{p}own_ends", F.transform("secrets", lambda s: s["end"]))
    out = out.withColumns({f"{p}ends": F.when(some, scanned(f"{p}own_ends", F.greatest)), f"{p}pieces": F.when(some, pieces(F.col(text_col)))})
    # What stands between the secrets before and each one, and its mark; nothing if they overlap.
    held, ends = F.col(f"{p}pieces"), F.col(f"{p}ends")

    def step(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get(ends, i - 1), F.lit(0))
        return F.when(s["start"] >= before, F.concat(cut(held, before, s["start"]), F.lit(REDACTED))).otherwise("")

    done = F.concat(F.array_join(F.transform("secrets", step), ""), cut(held, F.element_at(ends, -1), F.length(text_col)))
    out = out.withColumn(text_col, F.when(some, done).otherwise(F.col(text_col))).drop("secrets", f"{p}own_ends", f"{p}ends", f"{p}pieces")
    return out.withColumnRenamed(f"{p}own", "secrets").select(*(F.col(f"`{c}`") for c in docs.columns))
