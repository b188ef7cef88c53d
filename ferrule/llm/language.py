"""Missing or wrong document language labels: hierarchical discrimination.

Texts are cut into sentences. A sentence's family is predicted first (one linear
support vector machine per family), then one-versus-one machines separate the
languages within it. All machines share one table of hashed character n-grams
and are trained here by stochastic subgradient steps, on a bounded sample of
sentences whose documents carry a readable label; sentences that the first model
contradicts are left out of the second, since labels are partly wrong. Letters
are folded to lower case without accents, so that capitals and lost accents make
no difference.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.plans.session import spread

# Languages by family.
FAMILIES = {"germanic": ("en", "de", "nl"), "romance": ("fr", "es", "pt", "it"), "slavic": ("pl",)}
LANGUAGES = tuple(x for family in FAMILIES.values() for x in family)
FAMILY_OF = {x: f for f, family in FAMILIES.items() for x in family}
# Ways to name a language.
NAMES = {
    "en": "en eng english anglais englisch inglese ingles engels angielski",
    "de": "de deu ger german deutsch allemand aleman tedesco duits niemiecki alemao",
    "fr": "fr fra fre french francais franzosisch frances francese frans francuski",
    "es": "es spa spanish espanol castellano spanisch espagnol spagnolo spaans hiszpanski espanhol",
    "pt": "pt por portuguese portugues portugiesisch portugais portoghese portugees portugalski",
    "it": "it ita italian italiano italienisch italien italiaans wloski",
    "nl": "nl nld dut dutch nederlands niederlandisch neerlandais olandese flemish vlaams holenderski",
    "pl": "pl pol polish polski polnisch polonais polacco polaco pools",
}
# Frequent words of each language, the first training sentences.
FREQUENT = {
    "en": "the and of to in is that for it with as was on are you we our this have from will not be by or an at your",
    "de": "der die und in den von zu das mit sich des auf ist im nicht eine als auch es an werden aus er hat dass wir sie nach bei um",
    "nl": "de het een van en in is dat op te zijn voor met die niet aan er om ook als dan maar bij uit wij je onze naar wordt door",
    "fr": "le la les de des et en un une est que qui dans pour pas sur au avec ce il sont nous vous notre votre par plus du aux se ne son sa ses",
    "es": "el la los las de que y en un una es se no por con para su al lo como mas pero sus le ya este nuestro usted una del",
    "pt": "o a os as de que e em um uma do da no na se nao por com para mais como mas foi ao ele das seu sua voce nos uma pelo se",
    "it": "il la i gli le di che e un una per in con del della non si da sono come piu anche nel dei alla al ha questo lo una ci se su",
    "pl": "w i na z do sie nie to jest ze o jak od po za co dla przez przy tym ale czy oraz nasz ktory byc ma jego tego sa",
}
SETS = {x: frozenset(words.split()) for x, words in FREQUENT.items()}
PAIRS = [(a, b) for family in FAMILIES.values() for a, b in combinations(family, 2)]
COLUMNS = len(FAMILIES) + len(PAIRS)
FOLD = str.maketrans({"ß": "ss", "ł": "l", "Ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ı": "i"})
LETTERS = re.compile(r"[a-z]+")
BITS = 17
ORDERS = (2, 3, 4, 5)
MARK = re.compile(r"<[/!a-zA-Z][^<>]{0,1000}>|&(?:#\d{1,7}|[a-zA-Z]{2,10});")
BREAK = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n\s*\n|\n(?=\s*(?:[-*•✔▪>#–]|\d+[.)])\s)|(?<=[.!?…:;])\s*\n|\n(?=\s*[^a-z\s])")
QUOTED = re.compile(r"\n[ \t]*(?:>[ \t]?)+")
LEAD = re.compile(r"^[\s>*#•✔▪\-–—|\"'“„«(]+")
ENDS = re.compile(r"[.!?…][\"'”’»)*_\]]*\s*$")


def sentences_of(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of each piece of the text; whole: four words or more from a capital up to a closing mark."""
    out, at = [], 0
    plain = QUOTED.sub(lambda m: "\n" + " " * (len(m.group()) - 1), MARK.sub(lambda m: " " * len(m.group()), text))
    for stop in [*BREAK.finditer(plain), None]:
        end = stop.start() if stop else len(plain)
        piece = plain[at:end]
        if stop and plain[stop.start() : stop.end()].strip():
            piece = plain[at : stop.end()].rstrip()
        if piece.strip():
            lead = LEAD.match(piece)
            start = at + (lead.end() if lead else 0)
            body = plain[start : at + len(piece)]
            out.append((start, at + len(piece), bool(ENDS.search(body)) and not (body[:1].islower() or body[:1].isdigit()) and len(body.split()) >= 4))
        at = stop.end() if stop else end
    return out


def folded(text: str) -> tuple[str, ...]:
    """The words in lower case letters without accents; digits and marks separate them."""
    low = text.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFKD", low.translate(FOLD)).encode("ascii", "ignore").decode()
    return tuple(LETTERS.findall(low))


def grams(word: str) -> np.ndarray:
    """Table rows of the n-grams of a word with a blank at either end, and of the word itself."""
    buffer = np.frombuffer(f" {word} ".encode(), dtype=np.uint8).astype(np.uint32)
    rolling = np.zeros(len(buffer), dtype=np.uint32)
    out = [np.array([xxhash.xxh32_intdigest(word) >> (32 - BITS)], dtype=np.int64)]
    for order in range(1, min(max(ORDERS), len(buffer)) + 1):
        rolling = rolling[: len(buffer) - order + 1] * np.uint32(16777619) + (buffer[order - 1 :] + np.uint32(order * 131)) * np.uint32(2654435761)
        if order in ORDERS:
            out.append((rolling >> np.uint32(32 - BITS)).astype(np.int64))
    return np.concatenate(out)


class Scorer:
    """Scores texts word by word: a word's sum over the table is worked out once and kept, as a few words make up most of any text."""

    KEPT = 200_000  # words; then the memory starts anew, which changes no score

    def __init__(self, table: np.ndarray):
        self.table = table
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.table.shape[1] + 1), dtype=np.float32)

    def place(self, word: str) -> int:
        """Where the word's row is, made now."""
        k = self.at[word] = len(self.at)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        index = grams(word)
        self.rows[k, :-1] = self.table[index].sum(axis=0)
        self.rows[k, -1] = len(index)
        return k

    def scores(self, texts: list[tuple[str, ...]]) -> np.ndarray:
        """Sum over the n-grams of each text's words, divided by their number; zero for a text without words."""
        out = np.zeros((len(texts), self.table.shape[1]), dtype=np.float32)
        for lo in range(0, len(texts), 2000):
            part = texts[lo : lo + 2000]
            if len(self.at) > self.KEPT:
                self.forget()
            held = [(i, t) for i, t in enumerate(part) if t]
            if not held:
                continue
            at = self.at
            index = np.array([at[w] if w in at else self.place(w) for _, t in held for w in t])
            edges = np.concatenate([[0], np.cumsum([len(t) for _, t in held])[:-1]])
            summed = np.add.reduceat(self.rows[index], edges, axis=0)
            out[[lo + i for i, _ in held]] = summed[:, :-1] / summed[:, -1:]
        return out


def targets(language: str) -> np.ndarray:
    y = np.zeros(COLUMNS, dtype=np.float32)
    for i, family in enumerate(FAMILIES):
        y[i] = 1.0 if language in FAMILIES[family] else -1.0
    for i, (a, b) in enumerate(PAIRS):
        y[len(FAMILIES) + i] = 1.0 if language == a else -1.0 if language == b else 0.0
    return y


def train(sample: list[tuple[tuple[str, ...], str, int]], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> np.ndarray:
    """Table of weights from (words, language, times), by averaged subgradient steps on the hinge loss; a sentence seen several times steps as much further."""
    rng = np.random.default_rng(seed)
    table = np.zeros((1 << BITS, COLUMNS), dtype=np.float32)
    mean = np.zeros_like(table)
    known: dict[str, np.ndarray] = {}
    rows = []
    for words, language, times in sample:
        if words:
            index = np.concatenate([known[w] if w in known else known.setdefault(w, grams(w)) for w in words])
            index, count = np.unique(index, return_counts=True)
            rows.append((index, count.astype(np.float32), targets(language), times))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(len(rows)):
            index, count, y, times = rows[i]
            held = table[index]
            push = np.where(y * (count @ held) < count.sum(), y, 0)
            if push.any():
                table[index] = held + np.outer(count * (step * times), push)
        if epoch >= epochs // 2:
            mean += table
    return mean / max(1, epochs - epochs // 2)


def decide(score: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and confidence of each row of scores: family first, then the pairs within it."""
    families = list(FAMILIES)
    f = score[:, : len(families)]
    top = np.sort(f, axis=1)
    sure = (top[:, -1] - top[:, -2]).astype(np.float64)
    votes = np.zeros((len(score), len(LANGUAGES)))
    for j, (a, b) in enumerate(PAIRS):
        s = np.clip(score[:, len(families) + j], -1, 1)
        votes[:, LANGUAGES.index(a)] += s
        votes[:, LANGUAGES.index(b)] -= s
    member = np.array([[FAMILY_OF[x] == name for x in LANGUAGES] for name in families])[f.argmax(axis=1)] if len(score) else np.zeros((0, len(LANGUAGES)), dtype=bool)
    votes = np.where(member, votes, -np.inf)
    ranked = np.sort(votes, axis=1)
    several = member.sum(axis=1) > 1
    sure[several] = np.minimum(sure, ranked[:, -1] - ranked[:, -2])[several]
    return [LANGUAGES[k] for k in votes.argmax(axis=1)], 1 / (1 + np.exp(-4 * sure))


#: Accented letters of Latin script and their plain forms, by rule.
ACCENTED = {c: p for c in map(chr, range(0xC0, 0x250)) if len(p := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) == 1}
CODE_OF = {name: code for code, names in NAMES.items() for name in names.split()}


def label_code(label: Column) -> Column:
    """Two-letter code a label stands for; null where it is missing, a placeholder or not understood."""
    plain = F.regexp_replace(F.translate(F.lower(F.trim(label)), "".join(ACCENTED), "".join(ACCENTED.values())), r"[^\x00-\x7f]", "")
    name = F.regexp_extract(plain, r"^([^-_/ (]*)", 1)
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in CODE_OF.items() for x in pair)), name)


def fit(documents: DataFrame, text: str, lang: str, per_language: int = 600, longest: int = 20_000) -> np.ndarray:
    """Model from at most about ``per_language`` labelled documents of each language, chosen by a hash of their text.

    Documents over ``longest`` characters aren't chosen, so that the sample is
    bounded. Both bounds hold for the sample only: every document is labelled by
    the model, whole.
    """
    labelled = documents.select(F.col(f"`{text}`").alias("t"), label_code(F.col(f"`{lang}`")).alias("code")).where("t is not null and code is not null")
    total = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count("*").alias("n")).collect()}  # a row per language
    first: list[tuple[tuple[str, ...], str, int]] = [(folded(FREQUENT[x]), x, 20) for x in LANGUAGES]
    if not total:
        return train(first)
    cut = F.create_map(*(F.lit(x) for code, n in total.items() for x in (code, int(min(1.0, per_language / n) * 1_000_000))))
    sample = labelled.where((F.pmod(F.xxhash64("t"), F.lit(1_000_000)) < cut[F.col("code")]) & (F.length("t") <= longest))
    rows = sample.dropDuplicates(["t"]).collect()
    votes: dict[tuple[str, ...], Counter] = {}
    for r in rows:
        for a, b, whole in sentences_of(r["t"]):
            if whole and (f := folded(r["t"][a:b])):
                votes.setdefault(f, Counter())[r["code"]] += 1
    # A sentence goes by what most documents holding it are labelled; the oftener it stands, the surer that is.
    kept = dict.fromkeys(LANGUAGES, 0)
    pieces: list[tuple[tuple[str, ...], str, int]] = []
    for f in sorted(votes, key=lambda f: (-votes[f].total(), f)):
        code = min(votes[f], key=lambda x: (-votes[f][x], x))
        if contradicted(f, code):
            continue
        if kept[code] < 4 * per_language:
            kept[code] += 1
            pieces.append((f, code, min(8, votes[f].total())))
    # Labels are partly wrong: a first model is fitted to all, and pieces it puts elsewhere are dropped.
    table = train(first + pieces, epochs=3)
    said, _ = decide(Scorer(table).scores([f for f, _, _ in pieces])) if pieces else ([], None)
    return train(first + [p for p, x in zip(pieces, said) if p[1] == x])


def contradicted(sentence: tuple[str, ...], code: str) -> bool:
    """Whether the frequent words of the sentence speak more for another language than for the one its documents name."""
    counts = {x: sum(w in SETS[x] for w in sentence) for x in LANGUAGES}
    return max(counts.values()) > counts[code] + 1


def segments(documents: DataFrame, model: np.ndarray, doc_key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, label, seg_no, start_at, end_at, lang, confidence, whole: runs of sentences of one language.

    Sentences of low confidence take the language of the surer one before them
    (after them, at the beginning). ``whole`` says whether the run holds a whole
    sentence. Texts without any letters, null and empty texts give no segment.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = f"{doc_key} bigint, label string, seg_no int, start_at int, end_at int, lang string, confidence double, whole boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                b = batch.iloc[lo : lo + 1000]
                cuts = [sentences_of(t) for t in b["t"]]
                texts = [folded(t[a:e]) for t, c in zip(b["t"], cuts) for a, e, _ in c]
                said, sure = decide(scorer.scores(texts)) if texts else ([], np.zeros(0))
                at, rows = 0, []
                for k, label, c in zip(b["k"], b["l"], cuts):
                    part = [(a, e, w, said[at + i], float(sure[at + i]), e - a) for i, (a, e, w) in enumerate(c) if texts[at + i]]
                    at += len(c)
                    rows += [(k, label if isinstance(label, str) else None, *x) for x in joined(part)]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    slim = spread(documents.select(F.col(f"`{doc_key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where("t is not null and t <> ''"))
    return slim.mapInPandas(run, schema)


def joined(part: list[tuple[int, int, bool, str, float, int]], least: float = 0.9) -> list[tuple[int, int, int, str, float, bool]]:
    """Runs of one language; pieces that aren't whole or sure follow their neighbours."""
    if not part:
        return []
    weight: dict[str, float] = {}
    for _, _, w, x, s, n in part:
        if w and s >= least:
            weight[x] = weight.get(x, 0.0) + n * s
    if not weight:
        best: dict[str, float] = {}
        for _, _, _, x, s, n in part:
            best[x] = best.get(x, 0.0) + n * (s - 0.5)
        x = max(sorted(best), key=best.get)
        total = sum(n for *_, n in part)
        return [(1, part[0][0], part[-1][1], x, sum(s * n for _, _, _, y, s, n in part if y == x) / max(1, total), any(w for _, _, w, *_ in part))]
    current = next((x for _, _, w, x, s, _ in part if w and s >= least))
    runs: list[list] = []
    for a, e, w, x, s, n in part:
        if w and s >= least:
            current = x
        if runs and runs[-1][2] == current:
            runs[-1][1] = e
            runs[-1][3].append((s, n, x))
            runs[-1][4] |= w
        else:
            runs.append([a, e, current, [(s, n, x)], w])
    out = []
    for i, (a, e, x, parts, w) in enumerate(runs, 1):
        total = sum(n for _, n, _ in parts)
        out.append((i, a, e, x, sum((s if y == x else 1 - s) * n for s, n, y in parts) / total, bool(w)))
    return out


def relabelled(documents: DataFrame, doc_key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 600) -> DataFrame:
    """doc_id, lang, confidence for each document whose label is missing, wrong or insufficient: one row per language it has sentences in."""
    found = segments(documents, fit(documents, text, lang, per_language), doc_key, text, lang)

    by = found.groupBy(doc_key, "label", "lang").agg(
        (F.sum(F.col("confidence") * (F.col("end_at") - F.col("start_at"))) / F.sum(F.col("end_at") - F.col("start_at"))).alias("confidence")
    )
    docs = by.groupBy(doc_key, "label").agg(F.collect_list(F.struct("lang", "confidence")).alias("found"))
    named = docs.withColumn("code", label_code(F.col("label")))
    wrong = named.where(F.col("code").isNull() | (F.size("found") > 1) | (F.col("found")[0]["lang"] != F.col("code")))
    return wrong.select(doc_key, F.explode("found").alias("f")).select(doc_key, F.col("f.lang").alias("lang"), F.col("f.confidence").alias("confidence"))
