"""Column expressions over text, dates and numbers; all stay in the JVM unless the name says otherwise."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters of links that identify neither page nor posting.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "trk", "cs_origin", "lh_src", "ref", "referrer", "fbclid", "gclid")
LOCALE_PARAMS = ("lang", "language", "locale")
LEGAL_FORMS = ("inc", "llc", "ltd", "corp", "corporation", "gmbh", "ag", "sa", "sas", "bv", "plc", "co", "company", "limited")
# Words of a title that say how high a role is.
SENIORITY = tuple("junior mid middle senior staff principal lead head chief associate intern entry".split())
# Words that don't tell roles apart: levels, contract and work modes, job words, common places, prepositions.
ROLE_STOPWORDS = tuple(
    (
        "junior mid middle senior staff principal lead head chief associate intern entry level "
        "remote hybrid onsite contract contractor freelance fulltime parttime permanent temporary internship "
        "role position opportunity team based "
        "bangalore bengaluru mumbai delhi hyderabad pune chennai london berlin paris madrid barcelona amsterdam dublin "
        "york francisco seattle boston austin chicago toronto tokyo singapore sydney melbourne lisbon warsaw "
        "europe emea apac latam americas india spain germany france italy canada brazil mexico japan "
        "with from into over this that"
    ).split()
)
# Short words that do tell roles apart.
SHORT_SPECIALTIES = tuple("api sre sdk cli gpu cpu ios qa ux ui ar vr ocr crm erp".split())
# Words that can't be all that two like roles share.
BASELINE_WORDS = tuple("software engineer developer manager architect analyst designer consultant specialist platform systems services backend frontend full stack fullstack".split())
# Least characters of a normalised text that gets a fingerprint.
FINGERPRINT_LEAST = 200

def squeezed(c: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def spaced(c: Column) -> Column:
    """Lower case words of a-z and digits, one blank between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def without_legal_form(c: Column) -> Column:
    """``spaced`` without closing legal forms."""
    return F.regexp_replace(spaced(c), rf"(?: (?:{'|'.join(LEGAL_FORMS)}))+$", "")


@F.pandas_udf(T.StringType())
def compatibility_key(texts: pd.Series) -> pd.Series:
    """Letters and digits of the text's compatibility form (NFKC) in lower case; Python, as the JVM side has no NFKC."""
    return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).lower() if c.isalnum()) if isinstance(t, str) else None)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity, unlike ``round``, which rounds them away from zero."""
    f = 10.0**digits
    return F.floor(c * f + 0.5) / f


def iso_week(d: Column) -> Column:
    """``2026-W01``."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), d).cast("string"), 2, "0"))


def strict_date(c: Column) -> Column:
    """``YYYY-MM-DD`` that exists in the calendar; everything else is null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def leading_number(c: Column) -> Column:
    """The number a text begins with, as readers do that stop at the first other character (``4.2/5`` is 4.2)."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+(?:\.\d+)?)", 1).try_cast("double")


def money(c: Column) -> Column:
    """struct(low, high, mid) of an amount or span of amounts such as ``$84,000-109,500`` or ``70-85k``; ends in the wrong order are swapped.

    A trailing k counts for both ends. Null where the text isn't just an amount.
    """
    text = F.regexp_replace(F.lower(F.trim(c)), r"[,\s$€£]", "")
    pattern = r"^~?(\d+(?:\.\d+)?)(k?)(?:(?:-|–|to)(\d+(?:\.\d+)?)(k?))?(?:usd|eur|gbp|pln|chf)?$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    k = F.when((part(2) == "k") | (part(4) == "k"), 1000.0).otherwise(1.0)
    first = part(1).try_cast("double") * k
    second = F.coalesce(F.nullif(part(3), F.lit("")).try_cast("double") * k, first)
    low, high = F.least(first, second), F.greatest(first, second)
    return F.when(text.rlike(pattern), F.struct(low.alias("low"), high.alias("high"), ((low + high) / 2).alias("mid")))


def relative_age(c: Column) -> Column:
    """struct(days, at_least) of ``Posted 5 Days Ago``, ``30+ days ago``, ``today``, ``yesterday``; null for anything else."""
    text = F.lower(c)
    days = F.regexp_extract(text, r"(\d+)\s*(\+?)\s*days?\s+ago", 1)
    return (
        F.when(text.rlike(r"\btoday\b|just posted"), F.struct(F.lit(0).alias("days"), F.lit(False).alias("at_least")))
        .when(text.rlike(r"\byesterday\b"), F.struct(F.lit(1).alias("days"), F.lit(False).alias("at_least")))
        .when(days != "", F.struct(days.try_cast("int").alias("days"), (F.regexp_extract(text, r"\d+\s*(\+?)\s*days?\s+ago", 1) == "+").alias("at_least")))
    )


def role_tokens(c: Column) -> Column:
    """Distinct words of a role that tell roles apart: longer than three letters or a short specialty, no stop word."""
    keep = lambda w: ((F.length(w) > 3) | w.isin(*SHORT_SPECIALTIES)) & ~w.isin(*ROLE_STOPWORDS)
    return F.array_distinct(F.filter(F.split(spaced(c), " "), keep))


def seniorities(c: Column) -> Column:
    """The words of a title that say how high the role is."""
    return F.array_distinct(F.filter(F.split(spaced(c), " "), lambda w: w.isin(*SENIORITY)))


def same_role(a: Column, b: Column, at_least: float = 0.6) -> Column:
    """Whether two titles are likely one role: seniorities that meet where both name one, two shared tokens of which one is no baseline word, and a token Jaccard of ``at_least``."""
    shared = F.array_intersect(role_tokens(a), role_tokens(b))
    telling = F.size(F.filter(shared, lambda w: ~w.isin(*BASELINE_WORDS))) > 0
    return seniority_meets(seniorities(a), seniorities(b)) & (F.size(shared) >= 2) & telling & (token_jaccard(role_tokens(a), role_tokens(b)) >= at_least)


def seniority_meets(a: Column, b: Column) -> Column:
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def role_key(c: Column) -> Column:
    """``squeezed`` after closing bracketed asides (up to three) are dropped."""
    out = F.trim(c)
    for _ in range(3):
        out = F.trim(F.regexp_replace(out, r"\s*(?:\([^()]*\)|\[[^\[\]]*\])\s*$", ""))
    return squeezed(out)


def canonical_url(c: Column) -> Column:
    """Links that differ only in form become equal: https, lower-case host, no default port, fragment, tracking or locale parameters, sorted parameters, no closing slash.

    Texts that aren't http links are returned unchanged. A ``lang`` parameter
    goes only if its value looks like a locale (``lang=java`` stays).
    """
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(host, r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(c, r"^[^:]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)

    def kept(p: Column) -> Column:
        name, value = F.lower(F.substring_index(p, "=", 1)), F.substring_index(p, "=", -1)
        locale = name.isin(*LOCALE_PARAMS) & value.rlike(r"^[A-Za-z]{2}(?:[-_][A-Za-z]{2})?$")
        return (p != "") & ~name.isin(*TRACKING) & ~locale

    params = F.array_join(F.array_sort(F.filter(F.split(query, "&"), kept)), "&")
    built = F.concat(F.lit("https://"), host, path, F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), built).otherwise(c)


def html_text(c: Column) -> Column:
    """Plain text of markup: scripts and styles dropped, block ends become line feeds, tags blanks, the common entities undone."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def sentences(c: Column) -> Column:
    """Pieces ending in a full stop, question or exclamation mark followed by a blank; not after common abbreviations."""
    return F.filter(F.split(c, r"(?<!\b(?:e\.g|i\.e|Mr|Dr|No|vs)\.)(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def emails(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), 1)


def iso_dates(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\d{4}-\d{2}-\d{2})"), 1)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def initials(c: Column) -> Column:
    return F.array_join(F.slice(F.transform(F.filter(F.split(c, r"[^\p{L}]+"), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), 1, 2), "")


def host_under(url: Column, domain: str) -> Column:
    """Whether a link's host is the domain or under it (``x.lever.example``, not ``clever.example``)."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)", 1))
    return (host == domain) | host.endswith(f".{domain}")


def token_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hamming_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


@F.pandas_udf(T.StringType())
def last_object_with_status(texts: pd.Series) -> pd.Series:
    """The last complete JSON object in a text that has a ``status`` member, braces within strings and surrounding noise notwithstanding."""

    def find(t: str | None) -> str | None:
        if not isinstance(t, str):
            return None
        decoder, at, got = json.JSONDecoder(), 0, None
        while (at := t.find("{", at)) >= 0:
            try:
                value, end = decoder.raw_decode(t, at)
            except ValueError:
                at += 1
                continue
            if isinstance(value, dict) and "status" in value:
                got = json.dumps(value, ensure_ascii=False, sort_keys=True)
            at = end
        return got

    return texts.map(find)


def words_of_text(c: Column) -> Column:
    """Lower-case letters and digits of any script, one blank between words; without tags, entities and links."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "<[^>]*>", " "), "&[a-z#0-9]+;", " "), r"https?://\S+", " ")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(T.LongType())
def majority64(texts: pd.Series) -> pd.Series:
    """By majority over all runs of three words, each counted as often as it occurs, of the first 64 bits of their sha1; null for fewer than three words.

    Python, since 64 majorities over every text's runs make code that the JVM won't compile.
    """

    def one(t: str | None) -> int | None:
        words = t.split(" ") if isinstance(t, str) else []
        runs = Counter(" ".join(words[i : i + 3]) for i in range(len(words) - 2))
        if not runs:
            return None
        digests = np.frombuffer(b"".join(hashlib.sha1(r.encode()).digest()[:8] for r in runs), dtype=np.uint8).reshape(-1, 8)
        times = np.fromiter(runs.values(), dtype=np.int64)
        bits = (np.unpackbits(digests, axis=1) * times[:, None]).sum(axis=0) * 2 > times.sum()
        return int(np.packbits(bits).view(">i8")[0])

    return pd.Series([one(t) for t in texts], index=texts.index, dtype="Int64")


def simhash64(c: Column) -> Column:
    """64-bit SimHash of a text; null where its words have under ``FINGERPRINT_LEAST`` characters in all."""
    words = words_of_text(c)
    return majority64(F.when(F.length(words) >= FINGERPRINT_LEAST, words))
