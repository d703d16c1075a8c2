"""Text, URL and label functions: Column to Column, without UDFs except for full HTML and percent decoding."""

from __future__ import annotations

import functools
import html
import operator
import re
from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import HIGH_INTENT, INTENTS, PRICE_SIGNAL, STOP_WORDS, TRACKING

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
#: White space beyond the blank, as Unicode has it.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Letters that match an ASCII letter where case is ignored, besides its own two forms.
_FOLDS = {"\u017f": "s", "\u0130": "i", "\u0131": "i", "\u212a": "k"}


def squeeze(text: Column) -> Column:
    """White space (Unicode) collapsed to one space and stripped; texts without any but single blanks are left as they are."""
    odd = F.rlike(text, F.lit("[^\\x21-\\x7e\\u00a1-\\u167f ]|  "))
    return F.btrim(F.when(odd, F.regexp_replace(F.translate(text, _SPACES, " " * len(_SPACES)), " {2,}", " ")).otherwise(text))


def decoded(text: Column) -> Column:
    """Common HTML entities decoded, in texts that have any; `html_text` knows the full table."""
    plain = text
    for code, char in _ENTITIES:
        plain = F.replace(plain, F.lit(code), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)


def norm_text(text: Column) -> Column:
    """Common HTML entities decoded, white space collapsed; null as empty."""
    return squeeze(decoded(F.coalesce(text, F.lit(""))))


def _html_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(html.unescape(t or "").split()))


def html_text(text) -> Column:
    """As norm_text, with the full entity table, in an Arrow UDF."""
    return F.pandas_udf(_html_text, "string")(text)


def near_key(text: Column) -> Column:
    """Lower-cased words only: what near-duplicates agree on."""
    return F.btrim(F.regexp_replace(F.lower(decoded(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}_]+", " "))


def key_hash(key: Column) -> Column:
    """128 bits that stand for a long key in exchanges; null for an empty one."""
    return F.when(key != "", F.md5(key.cast("binary")))


#: Scheme, authority, path and query of a URL, whatever characters they hold.
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.translate(F.btrim(F.coalesce(url, F.lit(""))), "\t\r\n", ""), _URL, group)


def _unescaped(part: Column) -> Column:
    """A name or value of a query as it is meant: percent escapes and plus signs decoded; escapes that are none stay."""
    return F.when(F.rlike(part, F.lit("[%+]")), F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))).otherwise(part)


def _escaped(part: Column) -> Column:
    coded = F.replace(F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.when(F.rlike(part, F.lit(r"[^A-Za-z0-9_.\-]")), coded).otherwise(part)


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, port, user, www., fragment, tracking and blank parameters dropped, the rest sorted by
    what they mean and escaped in one way; blanks and odd characters do not hide the host.  Null as empty, empty stays."""
    scheme, path = F.lower(_part(url, 1)), _part(url, 3)
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    path = F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))
    named = F.filter(F.split(_part(url, 4), "&"), lambda p: F.rlike(p, F.lit("(?s)^[^=]*=.")))
    pairs = F.transform(named, lambda p: F.struct(_unescaped(F.substring_index(p, "=", 1)).alias("k"), _unescaped(F.substring(p, F.locate("=", p) + 1, 1 << 30)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda s: ~s["k"].isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda s: F.concat(_escaped(s["k"]), F.lit("="), _escaped(s["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), host_of(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.btrim(F.coalesce(url, F.lit(""))) == "", "").otherwise(whole)


def _decoded(urls: pd.Series) -> pd.Series:
    def one(u: str | None) -> str:
        parts = urlsplit((u or "").strip())
        if not any(parts):
            return ""
        host = (parts.hostname or "").lower().removeprefix("www.")
        path = parts.path or "/"
        path = (path.rstrip("/") or "/") if len(path) > 1 else path
        query = urlencode(sorted(kv for kv in parse_qsl(parts.query) if kv[0] not in TRACKING))
        return f"{(parts.scheme or 'https').lower()}://{host}{path}" + (f"?{query}" if query else "")

    return urls.map(one)


def canonical_url_decoded(url) -> Column:
    """canonical_url in an Arrow UDF, as SQL sees it."""
    return F.pandas_udf(_decoded, "string")(url)


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and www.; empty where the URL names none."""
    place = F.substring_index(_part(url, 2), "@", -1)
    host = F.when(F.startswith(place, F.lit("[")), F.regexp_extract(place, r"^\[([^\]]*)", 1)).otherwise(F.substring_index(place, ":", 1))
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def content_hash(canonical: Column, title: Column, snippet: Column) -> Column:
    return F.sha2(F.concat_ws("|", canonical, norm_text(title), norm_text(snippet)), 256)


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit("(?iU)" + pattern))


def folded(text: Column) -> Column:
    """Lower case, with every letter that matches an ASCII letter turned into it."""
    text = F.coalesce(text, F.lit(""))
    odd = F.rlike(text, F.lit(f"[{''.join(_FOLDS)}]"))
    return F.lower(F.when(odd, F.translate(text, "".join(_FOLDS), "".join(_FOLDS.values()))).otherwise(text))


def alternatives(pattern: str) -> list[tuple[str, str]]:
    """The alternatives of `pattern`, lower-cased, each with a string that any match of it holds: its longest literal stretch."""
    found, depth, start = [], 0, 0
    for i, c in enumerate(pattern + "|"):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            one = pattern[start:i]
            part = re.sub(r"\([^()]*\)\??|\[[^\]]*\][*+?]?|\\[bBwWsSdD][*+?]?|\\?.[*?]|[.+]", "\0", one.replace("\\$", "$").replace("\\.", "\0"))
            found.append((one, max(part.split("\0"), key=len).lower()))
            start = i + 1
    return found


def literal_first(alternative: str) -> str:
    """The same alternative with a word boundary before leading letters looked for behind them, so that a search is one for the letters."""
    m = re.match(r"\\b([a-z ]+)(?![a-z ?*+])", alternative) or re.match(r"\\b([a-z ]+)(?=[a-z ][?*+])", alternative)
    return f"{m[1]}(?<=\\b{m[1]}){alternative[m.end():]}" if m else alternative


def found(fold: Column, pattern: str) -> Column:
    """Whether `pattern` (lower case) occurs in a folded text.

    An alternative is only tried on texts that hold its literal stretch, by plain substring search, which is far cheaper.
    """
    each = dict.fromkeys(alternatives(pattern))
    return functools.reduce(operator.or_, [F.contains(fold, F.lit(a)) & F.rlike(fold, F.lit("(?U)" + literal_first(one))) for one, a in each])


def intents(text: Column, fold: Column | None = None) -> Column:
    """All families whose pattern occurs, in their fixed order; `fold` is folded(text), where it is at hand as a column."""
    fold = folded(text) if fold is None else fold
    return F.array_compact(F.array(*[F.when(found(fold, p), F.lit(name)) for name, p in INTENTS.items()]))


def is_high_intent(labels: Column) -> Column:
    return F.arrays_overlap(labels, F.array(*map(F.lit, HIGH_INTENT)))


def has_price_signal(text: Column, fold: Column | None = None) -> Column:
    return found(folded(text) if fold is None else fold, PRICE_SIGNAL)


def sentences(text: Column, least: int = 12, most: int = 12) -> Column:
    """Up to `most` sentences of `least` characters or more."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), squeeze_ends)
    return F.slice(F.filter(cut, lambda s: F.length(s) >= least), 1, most)


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def compress(text: Column, limit: int = 100) -> Column:
    """First sentence, white space collapsed; if longer than `limit`, cut at a word and closed with an ellipsis."""
    text = F.coalesce(text, F.lit(""))
    first = F.regexp_extract(text, r"^[^.?!]*", 0)
    blank = F.btrim(F.translate(first, _SPACES, " " * len(_SPACES))) == ""
    flat = squeeze(F.when(blank, text).otherwise(first))
    head = F.substring(flat, 1, limit - 1)
    at_word = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(at_word, "[ \t,;:—-]+$", ""), F.lit("…")))


def label_tokens(title: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"([a-z][a-z0-9+-]{2,})"), 1)
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def norm_query(text: Column) -> Column:
    return F.lower(squeeze(text))


def strip_fences(text: Column) -> Column:
    """A JSON answer without its code fence, or the first bracketed stretch of it."""
    bare = F.regexp_replace(F.btrim(text), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    return F.when(F.try_parse_json(bare).isNotNull(), bare).otherwise(F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1))


def clamp(value: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value.cast("double")))


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("int")


def cac_ceiling(price: Column, margin: Column, months: Column) -> Column:
    return F.round(price * margin * months, 2)


def is_close(a: Column, b: Column, rel: float = 1e-6, absolute: float = 0.01) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def carries_text(value: Column) -> Column:
    """True where a JSON object's top-level string values cite a row or run to 200 characters: leaked source text."""
    from .vocabulary import EVIDENCE_ID

    strings = F.filter(F.map_values(F.from_json(value, "map<string,string>")), lambda v: v.isNotNull())
    typed = F.regexp_extract_all(value, F.lit(r'"(?:[^"\\]|\\.)*"\s*:\s*"((?:[^"\\]|\\.)*)"'), 1)
    leaky = lambda v: F.rlike(v, F.lit(EVIDENCE_ID)) | (F.length(v) >= 200)
    return F.coalesce(F.exists(F.array_intersect(strings, typed), leaky) | F.exists(typed, leaky), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """0 for missing, empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.coalesce((F.size(a) > 0) & (F.size(a) == F.size(b)), F.lit(False)), F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))).otherwise(0.0)


# ---------------------------------------------------------------- rendering and Python's own arithmetic
def html_escape(text: Column) -> Column:
    """The five characters that HTML reserves, as entities."""
    out = F.coalesce(text, F.lit(""))
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def title_case(text: Column) -> Column:
    """Every run of letters with its first one upper-cased and the others lower-cased, whatever stands before it."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), 1), F.initcap), "")


def percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def cut(text: Column, most: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def py_round(value, digits: int) -> Column:
    """Python's rounding: of the binary value, half to even.  An Arrow UDF, for the few rows of reports and scores."""
    return F.pandas_udf(lambda s: s.map(lambda v: v if v != v else round(v, digits)), "double")(value)


def register(spark) -> None:
    """The functions that SQL users may want by name."""
    from .pricing import PRICE, _offers

    spark.udf.register("html_text", F.pandas_udf(_html_text, "string"))
    spark.udf.register("canonical_url", F.pandas_udf(_decoded, "string"))
    spark.udf.register("parse_prices", F.pandas_udf(_offers, PRICE))
