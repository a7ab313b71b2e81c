"""Scalar expressions over text, paths and times; all run inside the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The patterns of messages and hashes.
PREFIX = r"^[a-z]+(\([^)]+\))?:\s+"
REVERT_SUBJECT = r"^Revert\b"
REVERT_BODY = r"(?i)This reverts commit ([0-9a-f]{7,64})"
SHA = r"^[0-9a-f]{4,40}$"


def _folds() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, from Unicode's own decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _folds()
#: Marks that stand after their letter in decomposed texts.
COMBINING = "[\u0300-\u036f]"


def fold(col):
    """Lower case without diacritics of Latin letters, composed or not."""
    return F.translate(F.regexp_replace(F.lower(col), COMBINING, ""), MARKED, BARE)


def folded(text: str) -> str:
    """``fold`` for the words of a query."""
    return re.sub(COMBINING, "", text.lower()).translate(str.maketrans(MARKED, BARE))


def tokens(col):
    """Runs of letters and digits, folded, in order."""
    return F.regexp_extract_all(fold(col), F.lit(r"([\p{L}\p{N}]+)"))


def strip_prefix(subject):
    """A subject without its conventional-commit prefix."""
    return F.regexp_replace(subject, PREFIX, "")


def is_revert(subject, body):
    return subject.rlike(REVERT_SUBJECT) | body.rlike(REVERT_BODY)


def reverted_prefix(body):
    return F.nullif(F.lower(F.regexp_extract(body, REVERT_BODY, 1)), F.lit(""))


def top_dir(path):
    """First directory of a path; ``.`` for files at the root."""
    return F.when(F.instr(path, "/") > 1, F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def full_dir(path):
    """All directories of a path; ``.`` for files at the root."""
    return F.when(F.instr(path, "/") > 1, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def words(identifier):
    """Words of a camelCase, snake_case or kebab-case identifier, lower-cased."""
    cut = F.split(F.regexp_replace(identifier, "([a-z0-9])([A-Z])", "$1_$2"), "[_-]")
    return F.filter(F.transform(cut, F.lower), lambda w: w != "")


def case_variants(identifier):
    """camelCase, snake_case and kebab-case of an identifier, without those that are its lower-case form."""
    w = words(identifier)
    rest = F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))))
    camel = F.concat(F.get(w, F.lit(0)), F.array_join(rest, ""))
    return F.filter(F.array(camel, F.array_join(w, "_"), F.array_join(w, "-")), lambda v: (v != F.lower(identifier)) & (v != ""))


def code_items(text):
    """Of each identifier of a text, of three letters or more: its case variants, then its parts of that length.

    An identifier of one word is its own only part and has no other variant, which one pattern tells.
    """
    found = F.filter(F.regexp_extract_all(text, F.lit("([a-zA-Z][a-zA-Z0-9_-]*)")), lambda i: F.length(i) >= 3)
    several = lambda i: F.concat(case_variants(i), F.filter(F.split(i, "[_-]"), lambda p: F.length(p) >= 3))
    return F.flatten(F.transform(found, lambda i: F.when(i.rlike("[_-]|[a-z0-9][A-Z]"), several(i)).otherwise(F.array(i))))


def expanded(subject, body, dirs, cap: int = 4096):
    """Subject, body and directories, then the code items of each in turn, as long as the whole stays below ``cap`` bytes.

    Items that do not fit are left out and shorter ones after them may still fit; a text that is too long by itself
    gets none and is not cut.
    """
    body = F.coalesce(body, F.lit(""))
    whole = F.concat(subject, F.when(body != "", F.concat(F.lit("\n"), body)).otherwise(""), F.array_join(F.transform(dirs, lambda d: F.concat(F.lit(" "), d)), ""))
    items = F.concat(code_items(subject), code_items(body), F.flatten(F.transform(dirs, code_items)))

    def fitted(x):
        start = F.struct(F.octet_length(x["whole"]).alias("n"), F.array().cast("array<string>").alias("out"))

        def add(acc, item):
            n = acc["n"] + F.length(item) + 1  # items are ASCII
            return F.when(n < cap, F.struct(n.alias("n"), F.concat(acc["out"], F.array(item)).alias("out"))).otherwise(acc)

        return F.concat_ws(" ", x["whole"], F.aggregate(x["items"], start, add, lambda acc: acc["out"]))

    def text(x):
        every = F.concat_ws(" ", x["whole"], x["items"])
        return F.when(F.octet_length(x["whole"]) >= cap, x["whole"]).when(F.octet_length(every) < cap, every).otherwise(fitted(x))

    # the row of an array of one: the text and its items are found once, whatever number of times the rule names them
    return F.get(F.transform(F.array(F.struct(whole.alias("whole"), items.alias("items"))), text), F.lit(0))


def cut_bytes(text, cap: int, mark: str = "…"):
    """A text of more than ``cap`` bytes cut to whole characters within them, and marked."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))

    def add(acc, c):
        n = acc["n"] + F.octet_length(c)
        return F.struct(n.alias("n"), F.when(n <= cap, F.concat(acc["out"], c)).otherwise(acc["out"]).alias("out"))

    kept = F.aggregate(F.split(F.substring(text, 1, cap), ""), start, add, lambda acc: acc["out"])
    return F.when(F.octet_length(text) > cap, F.concat(kept, F.lit(mark))).otherwise(text)


@F.pandas_udf(StringType())
def compatible_form(text: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for; for distinct names, not for rows of commits."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normal_name(name):
    """In compatible composed form, trimmed, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(compatible_form(name), r"\s+", " ")))


def is_bot(name, email, listed=()):
    """A bot by the form of its e-mail or name, or by being listed (names or e-mails)."""
    by_form = F.lower(email).endswith("[bot]@users.noreply.github.com") | F.trim(name).endswith("[bot]")
    known = [x.lower() for x in listed]
    return by_form | F.lower(F.trim(name)).isin(known) | F.lower(email).isin(known) if known else by_form


def is_noreply(email):
    return F.lower(email).endswith("@users.noreply.github.com")


def recency(at, now: int, half_life_days: float = 180.0):
    """0.5 ** (age / half life), 1 for times after ``now``."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(now) - at, F.lit(0)) / F.lit(half_life_days * 86400.0))


def path_relevance(dirs, wanted: str | None):
    """1 where a directory is, or lies below, ``wanted``; 0.5 where both are single components that differ; else 0."""
    wanted = (wanted or "").rstrip("/")
    if not wanted:
        return F.lit(0.0)
    within = F.exists(dirs, lambda d: (d == wanted) | d.startswith(wanted + "/"))
    sibling = F.lit(False) if "/" in wanted or wanted == "." else F.exists(dirs, lambda d: (F.instr(d, "/") == 0) & (d != "."))
    return F.when(within, 1.0).when(sibling, 0.5).otherwise(0.0)


def coauthors(body):
    """(name, email) of the trailers of a message, first occurrences in order; malformed ones are left out."""
    lines = F.filter(F.split(body, "\n"), lambda s: F.lower(F.trim(F.substring_index(s, ":", 1))) == "co-authored-by")
    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.regexp_extract(s, r"^[^:]*:([^<]*)<", 1)).alias("name"), F.trim(F.regexp_extract(s, r"<([^<>]*)>[^>]*$", 1)).alias("email")))
    return F.array_distinct(F.filter(pairs, lambda p: (p["name"] != "") & (p["email"] != "")))


def glob_regex(glob: str) -> str:
    """An anchored regular expression: ``*`` crosses ``/``, ``**/`` may be empty, braces and classes as usual."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("/**/", i):
            out, i = out + "(?:/|/.*/)", i + 4
        elif glob.startswith("**/", i) and i == 0:
            out, i = out + "(?:/?|.*/)", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.*", i + 3
        elif glob[i] == "*":
            out, i = out + ".*", i + (2 if glob.startswith("**", i) else 1)
        elif glob[i] == "?":
            out, i = out + ".", i + 1
        elif glob[i] == "{":
            out, i = out + "(?:", i + 1
        elif glob[i] == "}":
            out, i = out + ")", i + 1
        elif glob[i] == "," and out.count("(?:") > out.count(")"):
            out, i = out + "|", i + 1
        elif glob[i] == "[" and "]" in glob[i:]:
            j = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def resolve_time(value: str, until: bool = False) -> int:
    """Epoch seconds of an ISO time, a date (start or, for until, end of the UTC day) or a whole number."""
    from datetime import datetime, timezone

    from ..errors import EngineError

    if re.fullmatch(r"-?\d+", value):
        return int(value)
    try:
        t = datetime.fromisoformat(value)
    except ValueError:
        raise EngineError("invalid_ref", f"not a time: {value}") from None
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return int(t.timestamp()) + (86399 if until and re.fullmatch(r"\d{4}-\d{2}-\d{2}", value) else 0)


def branch_ref(name: str) -> str:
    return name if name.startswith("refs/") else f"refs/heads/{name}"


def clean_query(text: str) -> str:
    """Lower-cased query without NULs; inner quotes doubled, a quoted phrase kept as one."""
    from ..errors import EngineError

    q = text.replace("\0", "").strip().lower()
    if not q:
        raise EngineError("invalid_query", "empty query")
    if len(q) >= 2 and q[0] == q[-1] == '"':
        return '"' + q[1:-1].replace('"', '""') + '"'
    return q.replace('"', '""')


def hash_name(value: str) -> str:
    """A commit hash, whole or abbreviated, in lower case."""
    from ..errors import EngineError

    if not re.fullmatch(r"[0-9a-fA-F]{1,64}", value):
        raise EngineError("invalid_ref", f"not a hash: {value}")
    return value.lower()


def digest_path(path: str) -> str:
    """A short stable name for a path, for folders outside of it."""
    import hashlib

    return hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
