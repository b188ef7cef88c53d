"""Posting links: the board site, employer path and posting code a link stands for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Board:
    """How one kind of job board writes its links.

    ``host``: pattern of the whole lower-case host; its first group, if any, is the
    employer. ``path`` and ``query``: patterns over the decoded path and query, with
    the employer and code in the groups given (0: not there).
    """

    name: str
    host: str
    path: str
    employer: tuple[str, int]
    code: tuple[str, int]
    query_employer: str = ""
    query_code: str = ""


# The boards' link forms.
BOARDS = (
    Board("persona", r"^(?:www\.)?([a-z0-9-]+)\.jobs\.persona\.example$", r"^/job/([^/]+)", ("host", 1), ("path", 1)),
    Board("dayworks", r"^(?:www\.)?([a-z0-9-]+\.wd[0-9]+)\.dayworks\.example$", r"/job/.*_([A-Za-z]*[0-9][0-9A-Za-z-]*)(?:/apply)?$", ("host", 1), ("path", 1)),
    Board("crankshaft", r"^(?:www\.)?(jobs)\.crankshaft\.example$", r"^/([^/]+)/([^/]+)", ("path", 1), ("path", 2)),
    Board("leafhire-form", r"^(?:www\.)?(boards)\.leafhire\.example$", r"^/embed/", ("query", 0), ("query", 0), "for", "lh_jid"),
    Board("leafhire", r"^(?:www\.)?(boards)\.leafhire\.example$", r"^/([^/]+)/jobs/([^/]+)", ("path", 1), ("path", 2)),
    Board("careers", r"^(?:www\.)?careers\.([a-z0-9-]+)\.example$", r"^/job$", ("host", 1), ("query", 0), "", "source"),
    Board("careers", r"^(?:www\.)?careers\.([a-z0-9-]+)\.example$", r"^/openings$", ("host", 1), ("query", 0), "", "ref_no"),
)
EDGE = r"^[\s<(\[\"']+|[\s>)\]\"'.,;]+$"


def unwrapped(bare: Column) -> Column:
    """Of a link without enclosing marks, the one carried inside a redirector's query, if there is one."""
    inner = F.regexp_extract(bare, r"[?&][A-Za-z_]+=(https?%3[aA]%2[fF][^&\s]+)", 1)
    return once(inner, lambda i: F.when(i != "", F.regexp_replace(F.coalesce(F.try_url_decode(i), i), EDGE, "")).otherwise(bare))


def param(query: Column, name: str) -> Column:
    return F.regexp_extract(query, rf"(?:^|&){name}=([^&#]*)", 1)


# Path segments that say nothing about employer or posting.
COMMON_SEGMENTS = "job jobs career careers opening openings position positions posting postings vacancy vacancies apply application view detail details embed o p j en de fr es it nl pl pt".split()
#: Parameters that identify neither page nor posting.
IDLE_PARAMS = r"^(?:utm_[a-z]+|trk|cs_origin|[a-z]+_src|ref|referrer|source_type|fbclid|gclid|lang|language|locale|hl)="


def general_parts(host: Column, path: Column, query: Column) -> Column:
    """struct(site, code) of a link of unknown form: the host with the words of the path before the last, and the last; or null.

    Numbers in parameters belong to the code. A code after the wording of a title is taken alone. A
    link without such words and numbers, or of a single word without a digit, names no posting.
    """
    segments = F.filter(
        F.split(F.lower(path), "/"),
        lambda s: (s != "") & ~s.isin(COMMON_SEGMENTS) & ~s.rlike("^[a-z]{2}[-_][a-z]{2}$"),
    )
    numbers = F.array_sort(F.filter(F.split(F.lower(query), "&"), lambda q: q.rlike("=.*[0-9]") & ~q.rlike(IDLE_PARAMS)))

    def named(x: Column) -> Column:
        last = F.coalesce(F.get(x["s"], F.size(x["s"]) - 1), F.lit(""))
        after_title = F.regexp_extract(last, "^[a-z].*[-_]([a-z]{0,3}[0-9]{3,}[a-z0-9]*)$", 1)
        code = F.concat_ws("&", F.when(last != "", F.when(after_title != "", after_title).otherwise(last)), x["n"])
        names = (F.size(x["n"]) > 0) | (F.size(x["s"]) > 1) | last.rlike("[0-9]")
        before = F.slice(x["s"], 1, F.greatest(F.size(x["s"]) - 1, F.lit(0)))
        site = F.concat_ws("|", F.regexp_replace(host, r"^www\.", ""), F.array_join(before, "/"))
        return F.when((host != "") & host.contains(".") & names & (code != ""), F.struct(site.alias("site"), code.alias("code")))

    return once(F.struct(segments.alias("s"), numbers.alias("n")), named)


def posting_parts(url: Column) -> Column:
    """struct(site, code): board site with employer path, and posting code, in lower case; or null where the link names no posting.

    Scheme, port, letter case, doubled or closing slashes, percent-encoding, locale
    segments, the wording of a title, ``/apply``, fragments, tracking parameters and
    the order of parameters make no difference. Links of the boards listed are read by their
    forms, others by ``general_parts``.
    """
    bare = once(url, lambda u: once(F.regexp_replace(u, EDGE, ""), unwrapped))
    rest = once(bare, lambda u: F.regexp_replace(once(u, unwrapped), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))

    def split(u: Column) -> Column:
        after = F.regexp_replace(u, r"^[^/?#]+", "")
        raw_path = F.regexp_extract(after, r"^([^?#]*)", 1)
        path = F.regexp_replace(F.regexp_replace(once(raw_path, lambda p: F.coalesce(F.try_url_decode(p), p)), r"/{2,}", "/"), r"[/\s.,;]+$", "")
        host = F.lower(F.regexp_extract(u, r"^([^/?#:]+)", 1))
        return F.struct(host.alias("host"), path.alias("path"), F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1).alias("query"))

    return once(once(rest, split), lambda x: parts_of(x["host"], x["path"], x["query"]))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out a single time, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parts_of(host: Column, path: Column, query: Column) -> Column:
    """``posting_parts`` of a link taken apart."""
    readings = []
    for board in BOARDS:

        def part(where: tuple[str, int], name: str, b: Board = board) -> Column:
            kind, group = where
            if kind == "query":
                value = once(param(query, name), lambda v: F.coalesce(F.try_url_decode(v), v))
            else:
                value = F.regexp_extract(host if kind == "host" else path, b.host if kind == "host" else b.path, group)
            return F.lower(F.regexp_replace(value, EDGE, ""))

        both = F.struct(F.concat_ws("|", F.lit(board.name.split("-")[0]), part(board.employer, board.query_employer)).alias("site"), part(board.code, board.query_code).alias("code"))
        whole = once(both, lambda x: F.when(~x["site"].endswith("|") & (x["code"] != ""), x))
        readings.append(F.when(host.rlike(board.host) & path.rlike(board.path), whole))
    unlisted = ~host.rlike("|".join(f"(?:{b.host})" for b in BOARDS))
    return F.coalesce(*readings, F.when(unlisted, general_parts(host, path, query)))


def posting_key(url: Column) -> Column:
    """``site|code`` of ``posting_parts``, or null."""
    return once(posting_parts(url), lambda p: F.when(p.isNotNull(), F.concat_ws("|", p["site"], p["code"])))
