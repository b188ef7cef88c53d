"""Job boards as a data source: one partition per board file, each read by the mapping of its provider.

Boards are files here (JSON, RSS or HTML with JSON-LD), since nothing is fetched
over the network. A provider is data: where the list is and which member is which
field, so that adding one takes no code.
"""

from __future__ import annotations

import glob
import html
import json
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = (
    "board string, provider string, title string, url string, company string, location string, description string, posted_at timestamp, "
    "salary struct<min:double,max:double,currency:string>"
)


@dataclass(frozen=True)
class Provider:
    """``host``: pattern of the links that this provider serves. ``items``: path to the list. The rest: paths within an item, parts joined by a dot."""

    name: str
    kind: str
    host: str
    items: str = ""
    title: str = "title"
    url: str = "url"
    company: str = ""
    location: str = "location"
    description: str = "description"
    posted: str = ""
    low: str = ""
    high: str = ""
    currency: str = ""


# Payload forms. Order matters: the first whose host fits a link serves it. Paths may have alternatives (|), places in lists, and links be built from members ({}).
PROVIDERS = (
    Provider("greenhouse", "json", r"(^|\.)greenhouse\.io$", items="jobs", url="absolute_url", location="location.name", description="content", posted="first_published|updated_at"),
    Provider("lever", "json", r"(^|\.)lever\.co$", title="text", url="hostedUrl", location="categories.location", description="descriptionPlain", posted="createdAt"),
    Provider("ashby", "json", r"(^|\.)ashbyhq\.com$", items="jobs", url="jobUrl", description="descriptionPlain", posted="publishedAt"),
    Provider("workday", "json", r"(^|\.)myworkdayjobs\.com$", items="jobPostings", url="https://{host}{externalPath}", location="locationsText"),
    Provider("smartrecruiters", "json", r"(^|\.)smartrecruiters\.com$", items="content", title="name", url="https://jobs.smartrecruiters.com/{company.identifier}/{id}", company="company.name", location="location.fullLocation|location.city", posted="releasedDate"),
    Provider("recruitee", "json", r"(^|\.)recruitee\.com$", items="offers", url="careers_url|url", location="location|city", posted="published_at"),
    Provider("personio", "xml", r"(^|\.)personio\.(?:de|com)$", items="position", title="name", url="https://{host}/job/{id}", location="office", posted="createdAt"),
    Provider("breezy", "json", r"(^|\.)breezy\.hr$", title="name", url="url", location="location.name", posted="published_date"),
    Provider("bamboohr", "json", r"(^|\.)bamboohr\.com$", items="result", title="jobOpeningName", url="https://{host}/careers/{id}", location="location.city|location.state"),
    Provider("rippling", "json", r"(^|\.)rippling\.com$", title="name", url="url", location="workLocation.label"),
    Provider("pinpoint", "json", r"(^|\.)pinpointhq\.com$", items="data", url="url", location="location.name|location.city"),
    Provider("arbeitnow", "json", r"(^|\.)arbeitnow\.com$", items="data", company="company_name", posted="created_at"),
    Provider("remotive", "json", r"(^|\.)remotive\.com$", items="jobs", company="company_name", location="candidate_required_location", posted="publication_date"),
    Provider("remoteok", "json", r"(^|\.)remoteok\.(?:com|io)$", title="position", company="company", posted="epoch|date", low="salary_min", high="salary_max"),
    Provider("himalayas", "json", r"(^|\.)himalayas\.app$", items="jobs", url="applicationLink|guid", company="companyName", location="locationRestrictions", posted="pubDate", low="minSalary", high="maxSalary", currency="currency"),
    Provider("jobicy", "json", r"(^|\.)jobicy\.com$", items="jobs", title="jobTitle", company="companyName", location="jobGeo", description="jobDescription", posted="pubDate"),
    Provider("themuse", "json", r"(^|\.)themuse\.com$", items="results", title="name", url="refs.landing_page", company="company.name", location="locations.0.name", posted="publication_date"),
    Provider("workingnomads", "json", r"(^|\.)workingnomads\.com$", company="company_name", posted="pub_date"),
    Provider("weworkremotely", "rss", r"(^|\.)weworkremotely\.com$"),
    Provider("larajobs", "rss", r"(^|\.)larajobs\.com$"),
    Provider("nodesk", "rss", r"(^|\.)nodesk\.co$"),
    Provider("jobspresso", "rss", r"(^|\.)jobspresso\.co$"),
    Provider("leafhire", "json", r"(^|\.)leafhire\.", items="jobs", url="absolute_url", location="location.name", description="content", posted="updated_at"),
    Provider("crankshaft", "json", r"(^|\.)crankshaft\.", title="text", url="hostedUrl", location="categories.location", description="descriptionPlain", posted="createdAt"),
    Provider(
        "persona", "json", r"(^|\.)persona\.", items="positions", title="name", url="link", location="office", posted="published",
        low="pay.min", high="pay.max", currency="pay.currency",
    ),
    Provider("dayworks", "json", r"(^|\.)dayworks\.", items="jobPostings", url="externalPath", location="locationsText", posted="postedOn"),
    Provider("feed", "rss", r"(^|\.)rss\."),
    Provider("page", "html", r"."),
)


def provider_for(url: str, named: str = "", skip: frozenset[str] = frozenset()) -> Provider | None:
    """The provider named, else the first whose host pattern fits; ``skip`` leaves some out, for a second try."""
    for p in PROVIDERS:
        if named and p.name == named:
            return p
    host = re.sub(r"^[a-z]+://", "", url.lower()).split("/")[0]
    return next((p for p in PROVIDERS if p.name not in skip and re.search(p.host, host)), None) if not named else None


def member(item: object, path: str) -> object:
    """What lies at a path of names and places; of alternatives the first that is there and not empty."""
    for way in path.split("|"):
        x = item
        for part in way.split(".") if way else []:
            x = x.get(part) if isinstance(x, dict) else x[int(part)] if isinstance(x, list) and part.isdigit() and int(part) < len(x) else None
        if x not in (None, "", []):
            return x
    return None


def built(item: object, form: str, host: str) -> str:
    """A member's text, or a link built of members; empty where one of them is missing."""
    if "{" not in form:
        return text(member(item, form))
    parts = {p: host if p == "host" else text(member(item, p)) for p in re.findall(r"\{([^}]+)\}", form)}
    return re.sub(r"\{([^}]+)\}", lambda m: parts[m[1]], form) if all(parts.values()) else ""


def as_dict(element: ET.Element) -> dict:
    """The element's children by name, repeated ones as a list."""
    out: dict = {}
    for c in element:
        value = as_dict(c) if len(c) else c.text
        out[c.tag] = value if c.tag not in out else [*(out[c.tag] if isinstance(out[c.tag], list) else [out[c.tag]]), value]
    return out


def moment(value: object) -> datetime | None:
    """Of epoch seconds or milliseconds, an ISO text or the date of a mail; None where it can't be read. Times are UTC."""
    try:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return datetime.fromtimestamp(value / 1000 if value > 1e11 else value, timezone.utc)
        if isinstance(value, str) and value:
            t = datetime.fromisoformat(value.replace("Z", "+00:00")) if value[:1].isdigit() else parsedate_to_datetime(value)
            return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    except (ValueError, OverflowError, OSError):
        return None
    return None


def number(value: object) -> float | None:
    try:
        return float(value) if value is not None and value != "" else None
    except (TypeError, ValueError):
        return None


def text(value: object) -> str:
    if isinstance(value, list):
        return ", ".join(x for x in map(text, value) if x)
    return value.strip() if isinstance(value, str) else "" if value is None or isinstance(value, dict) else str(value)


def postings_of(payload: str, p: Provider, board: str, host: str = "") -> list[tuple]:
    """Rows of ``SCHEMA``; items without title or link, and payloads that can't be read, give none."""
    rows = []
    try:
        if p.kind in ("json", "xml"):
            if p.kind == "xml":
                items = [as_dict(x) for x in ET.fromstring(payload).iter(p.items)]
            else:
                data = json.loads(payload)
                items = member(data, p.items) if p.items else data
            for i in items if isinstance(items, list) else []:
                pay = (number(member(i, p.low)), number(member(i, p.high)), text(member(i, p.currency)) or None if p.currency else None) if p.low else None
                rows.append(
                    (board, p.name, text(member(i, p.title)), built(i, p.url, host), (text(member(i, p.company)) or board) if p.company else board,
                     text(member(i, p.location)), text(member(i, p.description)) or None, moment(member(i, p.posted)) if p.posted else None, pay)
                )
        elif p.kind == "rss":
            for i in ET.fromstring(payload).iter("item"):
                rows.append((board, p.name, text(i.findtext("title")), text(i.findtext("link")), board, text(i.findtext("location")), text(i.findtext("description")) or None, moment(i.findtext("pubDate")), None))
        else:
            found = [*json_ld(payload, board), *hydrated(payload, board), *microdata(payload, board)]
            rows += [(board, p.name, *r) for k, r in enumerate(found) if r[1] not in {x[1] for x in found[:k]}]
    except (ValueError, ET.ParseError):
        return []
    return [r for r in rows if r[2] and r[3]]


def hydrated(page: str, board: str) -> list[tuple]:
    """Postings in the JSON by which a page is brought to life: objects, however deep, with a title and a link that speaks of a job."""
    out: list[tuple] = []

    def walk(x: object) -> None:
        if isinstance(x, dict):
            title, url = member(x, "title|jobTitle|name"), member(x, "url|absolute_url|jobUrl|hostedUrl|applyUrl")
            if isinstance(title, str) and isinstance(url, str) and re.search(r"job|career|position|opening|vacanc", url, re.IGNORECASE):
                out.append((text(title), text(url), text(member(x, "companyName|company.name|company")) or board, text(member(x, "location.name|location|city")), text(member(x, "description")) or None, moment(member(x, "datePosted|publishedAt|createdAt")), None))
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    for block in re.findall(r"(?is)<script[^>]*(?:id=[\"']__NEXT_DATA__[\"']|type=[\"']application/json[\"'])[^>]*>(.*?)</script>", page):
        try:
            walk(json.loads(html.unescape(block) if "&quot;" in block else block))
        except ValueError:
            continue
    return out


def microdata(page: str, board: str) -> list[tuple]:
    """Postings marked up as schema.org items, from one such mark to the next."""
    out = []
    for part in re.split(r"(?i)<[^>]*itemtype=[\"']https?://schema\.org/JobPosting[\"'][^>]*>", page)[1:]:

        def prop(name: str, part: str = part) -> str:
            m = re.search(rf"(?is)<[^>]*itemprop=[\"']{name}[\"'][^>]*?(?:content|href|datetime)=[\"']([^\"']*)[\"'][^>]*>|<[^>]*itemprop=[\"']{name}[\"'][^>]*>([^<]*)<", part)
            return html.unescape((m[1] or m[2] or "").strip()) if m else ""

        out.append((prop("title"), prop("url"), prop("name") or board, prop("addressLocality"), prop("description") or None, moment(prop("datePosted")), None))
    return out


def json_ld(page: str, board: str) -> list[tuple]:
    """Postings in the JSON-LD scripts of a page, however deep they are nested."""
    out: list[tuple] = []

    def walk(x: object) -> None:
        if isinstance(x, dict):
            if x.get("@type") == "JobPosting":
                base = member(x, "baseSalary.value") or {}
                pay = (number(member(base, "minValue")), number(member(base, "maxValue")), text(member(x, "baseSalary.currency")) or None) if base else None
                out.append(
                    (text(x.get("title")), text(x.get("url")), text(member(x, "hiringOrganization.name")) or board,
                     text(member(x, "jobLocation.address.addressLocality")), text(x.get("description")) or None, moment(x.get("datePosted")), pay)
                )
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    for block in re.findall(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", page):
        try:
            walk(json.loads(block))
        except ValueError:
            continue
    return out


class BoardPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class BoardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern, self.named = options["path"], options.get("provider", "")

    def partitions(self):
        return [BoardPartition(p) for p in sorted(glob.glob(self.pattern))]

    def read(self, partition):
        name = os.path.basename(partition.path)
        host, board = name.rsplit(".", 1)[0], name.split(".")[0]
        p = provider_for(host, self.named)
        if p is None:
            return
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            yield from postings_of(f.read(), p, board, host.split(".", 1)[-1] if "." in host else host)


class BoardSource(DataSource):
    """``spark.read.format("boards").option("path", "dir/*").load()``; files are named ``board.host.example.json``, from which the provider follows unless option ``provider`` names it."""

    @classmethod
    def name(cls):
        return "boards"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BoardReader(self.options)


def board_files(spark: SparkSession, path: str, named: str = "") -> DataFrame:
    """The same rows from files on whatever storage Spark reads, such as a cluster's: each file whole, by its own task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, content in zip(b["path"], b["content"]):
                name = unquote(file.rsplit("/", 1)[-1])
                host, board = name.rsplit(".", 1)[0], name.split(".")[0]
                if p := provider_for(host, named):
                    rows += postings_of(bytes(content).decode("utf-8", "replace"), p, board, host.split(".", 1)[-1])
            out = pd.DataFrame(rows, columns=[f.name for f in schema])
            out["salary"] = [dict(zip(("min", "max", "currency"), x)) if x else None for x in out["salary"]]
            out["posted_at"] = pd.to_datetime(out["posted_at"], utc=True)
            yield out

    schema = StructType.fromDDL(SCHEMA)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)
