"""Pages of strung-together keywords, bare links, tags or product attributes instead of sentences.

A text is read line by line. A line is suspect by its links (ratio of link text and no sentence around), its tags, or its
separators (many short items); other lines form paragraphs, which are suspect by their shares of repeated n-grams, top words and
duplicate lines, or because they hardly hold a function word at all. Suspect paragraphs and lists count only if they lack function words.
How many function words are too few is calibrated per language over all paragraphs of the corpus: LACK times the median share, weighted by
characters. Paragraphs whose sentences repeat their own words, as no sentence does, count whatever function words are strewn in. Code and
log lines are never suspect. A page is spam if suspect text makes up more than half of its characters, white space aside.

Texts marked as being in a language whose function words are not known are judged by links, tags and repetition within sentences alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocabula.scale import cut

#: Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": frozenset(
        "a an the and or but if of to in on at by for from with without as is are was were be been being it its this that these those "
        "which who whom whose what when where why how not no nor so than then there here we you they he she i our your their his her "
        "them us me my do does did has have had will would can could may might must shall should before after into over under between "
        "about while because until unless each every any some both one only still also all up out off per".split()
    ),
    "de": frozenset(
        "der die das den dem des ein eine einen einem einer eines und oder aber wenn ob dass weil in im an am auf aus bei mit nach von vom "
        "vor zu zum zur für um über unter zwischen durch ohne gegen ist sind war waren wird werden wurde wurden hat haben hatte hatten kann "
        "können muss müssen soll sollen nicht kein keine auch noch nur so wie als es er sie wir ihr ich man sich dieser diese dieses bitte "
        "alle jede jeder jedes hilft gilt bis seit".split()
    ),
}
#: Endings of Korean words that carry particles or verb forms (fixed values).
KOREAN_ENDING = re.compile(r"[가-힣A-Za-z0-9](?:은|는|이|가|을|를|에|에서|에게|의|로|으로|와|과|만|까지|부터|보다|처럼|마다|다|한다|된다|했다|이다|하고|하며|하면|되면|라서|지만|는데|는지|인가|한|할|된|될|하는|되는|있는|없는|뒤에는|때|지|고|며|면|해서|안에|나|요|죠|까)$")

LACK = 0.4
#: A paragraph of at least BARE_WORDS words with less than BARE of them function words is suspect, however they differ.
BARE_WORDS, BARE = 20, 0.03
#: Share of words that stand in their own sentence before, from which a paragraph of at least ECHO_WORDS words is strung together.
ECHO, ECHO_WORDS = 0.25, 12
_HANGUL = re.compile(r"[가-힣]")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)|<a\s[^>]*>.*?</a>|(?:https?://|www\.)\S+", re.I)
_TAG = re.compile(r"#[^\s#]+")
_ITEMS = re.compile(r"\s*[|;,·•‣›»>~→]+\s*|\s+[-–—/]+\s+")  # a slash within a word is a path
_LEAD = re.compile(r"^[\s>]*(?:[-*•·+]\s+(?:\[[ xX]\]\s+)?|\d{1,3}[.)]\s+)?")
_LABEL = re.compile(r"^[^\W\d_][\w \-]{0,24}[:=]\s*(?=\S)")
_LOG = re.compile(r"^\W*(?:\d{4}-\d\d-\d\d|\d\d:\d\d|\[?(?:INFO|WARN|ERROR|DEBUG|TRACE)\b)")
_FENCE = re.compile(r"^\s*(?:```|~~~)")
_SENTENCE = re.compile(r"[.!?。]+\s+(?=\S)")
_CODE = re.compile(r"[a-z]{2,3}(?=$|[-_])")
BINS = 100


def language(words: list[str], text: str) -> str:
    """ko if three in ten words or more are written in Hangul (a path or a name in a sentence has many parts); else the language with more function words, en first."""
    if not text.isascii() and sum(_HANGUL.search(w) is not None for w in words) * 10 >= 3 * len(words):
        return "ko"
    en, de = (sum(map(FUNCTION_WORDS[k].__contains__, words)) for k in ("en", "de"))
    return "de" if de > en else "en"


def function_share(words: list[str], lang: str) -> float:
    if not words:
        return 0.0
    if lang == "ko":
        return sum(KOREAN_ENDING.search(w) is not None for w in words if not w.isascii()) / len(words)
    return sum(map(FUNCTION_WORDS[lang].__contains__, words)) / len(words)


def _repetition(words: list[str], lines: list[str]) -> bool:
    """Repeated n-grams, a few words that make up the text, or the same lines again and again."""
    n = len(words)
    if n < 8:
        return False
    if len(lines) > 2 and len(set(lines)) * 2 <= len(lines):
        return True
    counts = Counter(words)
    if len(counts) <= 0.78 * n:  # else neither of the following can hold
        pairs = Counter(zip(words, words[1:]))
        if sum(c for c in pairs.values() if c > 1) >= 0.45 * (n - 1):
            return True
        if n >= 24 and sum(c for _, c in counts.most_common(n // 12)) >= 0.5 * n:
            return True
    return False


def _echo(lines: list[str]) -> bool:
    """Sentences say their words again: of all words at least ECHO stood in the same sentence before. Short lines are one sentence."""
    said = again = 0
    short: list[str] = []
    for line in lines:
        sentences = [_WORD.findall(x) for x in _SENTENCE.split(line.lower())]
        if len(sentences) == 1 and len(sentences[0]) <= 4:
            short += sentences.pop()
        for words in sentences:
            said += len(words)
            again += len(words) - len(set(words))
    return said + len(short) >= ECHO_WORDS and again + len(short) - len(set(short)) >= ECHO * (said + len(short))


def _marked(lang: str | None) -> str | None:
    """The language that a text is marked as, `other` if its function words are not known; None if it is not marked by a code."""
    m = _CODE.match((lang or "").strip().lower())
    return None if m is None else m[0] if m[0] in ("en", "de", "ko") else "other"


def _size(s: str) -> int:
    return len("".join(s.split()))


def blocks(text: str, marked: str | None = None) -> tuple[int, list[tuple[str, int, int, int]]]:
    """Characters without white space; and (language, function word share in BINS, characters, suspect characters) of each block. Blocks
    without a language are suspect whatever their function words."""
    out: list[tuple[str, int, int, int]] = []
    total, fenced, plain, plain_size = 0, False, [], 0
    other = _marked(marked) == "other"

    def close() -> None:
        nonlocal plain_size
        if plain:
            joined = " ".join(plain).lower()
            words = _WORD.findall(joined)
            lang = language(words, joined)
            share = function_share(words, lang)
            if _echo(plain):
                out.append(("", 0, plain_size, plain_size))
            elif other and lang != "ko":
                out.append(("other", BINS, plain_size, 0))
            else:
                suspect = _repetition(words, plain)
                if suspect and len(set(plain)) < len(plain):  # a line that stands many times speaks once
                    once = _WORD.findall(" ".join(dict.fromkeys(plain)).lower())
                    share = min(share, function_share(once, lang))
                suspect = suspect or (len(words) >= BARE_WORDS and share < BARE)
                out.append((lang, min(BINS, int(share * BINS)), plain_size, plain_size if suspect else 0))
            plain.clear()
            plain_size = 0

    for line in text.splitlines():
        n = _size(line)
        total += n
        if not n:
            close()
            continue
        if _FENCE.match(line):
            fenced = not fenced
            close()
            continue
        body = line[_LEAD.match(line).end() :].strip()
        if fenced or not body or _LOG.match(body):
            continue
        links = _LINK.findall(body) if "://" in body or "](" in body or "www." in body or "<a " in body.lower() else []
        rest = _LINK.sub(" ", body) if links else body
        if "#" in rest and not links:
            tags = _TAG.findall(rest)
            if tags and len(tags) >= 1.5 * len(_WORD.findall(_TAG.sub(" ", rest))):
                out.append(("", 0, n, n))
                continue
        if links:
            words = _WORD.findall(_TAG.sub(" ", rest).lower())
            part = sum(map(len, links)) / len(body)
            if part >= 0.6 or (part >= 0.3 and function_share(words, language(words, rest)) < 0.1):
                out.append(("", 0, n, n))
                continue
        label = _LABEL.match(rest)
        marks = sum(map(rest.count, (*",|;·•‣›»>~→–—", " / ", " - ")))
        if marks and (label or marks > 2) and rest.count(" ") < 10 * (marks + 1):
            listed = rest[label.end() :] if label else rest
            items = [x for x in _ITEMS.split(listed.strip(" |")) if _WORD.search(x)]
            if len(items) >= (2 if label else 4):
                counts = [len(_WORD.findall(x)) for x in items]
                if sum(counts) <= 3.5 * len(items) and max(counts) <= 6:
                    words = _WORD.findall(listed.lower())
                    lang = language(words, listed)
                    out.append(("", 0, n, n) if _echo([listed]) else (lang, min(BINS, int(function_share(words, lang) * BINS)), n, n))
                    continue
        plain.append(body)
        plain_size += n
    close()
    return total, out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.int32()), ("chars", pa.int64()), ("suspect", pa.int64())]))
    for b in batches:
        totals, found = [], []
        for t, marked in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            total, parts = blocks(t or "", marked)
            merged: dict[tuple[str, int], list[int]] = {}
            for lang, share, chars, suspect in parts:
                m = merged.setdefault((lang, share), [0, 0])
                m[0] += chars
                m[1] += suspect
            totals.append(total)
            found.append([{"lang": k[0], "share": k[1], "chars": v[0], "suspect": v[1]} for k, v in sorted(merged.items())])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(totals, pa.int64()), pa.array(found, kind)], ["doc_id", "total", "blocks"])


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """(doc_id, total, blocks): small beside the text. Null and empty texts have no blocks. lang: column of language codes, if there is one."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.col(lang).cast("string") if lang else F.lit(None).cast("string")).alias("lang"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return kept.mapInArrow(_features, f"doc_id {kind}, total long, blocks array<struct<lang: string, share: int, chars: long, suspect: long>>")


def thresholds(feats: DataFrame, lack: float = LACK) -> dict[str, int]:
    """By language the share of function words, in BINS, below which a paragraph lacks them: `lack` times the weighted median."""
    # shares come in BINS + 1 values, so this is at most that many rows for each of four classes of languages
    hist = feats.select(F.explode("blocks").alias("b")).filter("b.lang <> ''").groupBy("b.lang", "b.share").agg(F.sum("b.chars").alias("chars")).collect()
    out = {}
    for lang in {r["lang"] for r in hist}:
        mine = sorted((r["share"], r["chars"]) for r in hist if r["lang"] == lang)
        half, seen = sum(c for _, c in mine) / 2, 0
        for share, chars in mine:
            seen += chars
            if seen >= half:
                out[lang] = max(1, round(share * lack))
                break
    return out


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lack: float = LACK, lang: str | None = None) -> DataFrame:
    """(doc_id, total, suspect): characters, and those of suspect blocks that lack function words. Every row counts, copies too."""
    feats = cut(features(docs, doc_id, text, lang))
    limits = {"": 1, **thresholds(feats, lack)}

    def limit(b):
        out = F.lit(1)
        for lang, most in sorted(limits.items()):
            out = F.when(b["lang"] == lang, most).otherwise(out)
        return out

    suspect = F.aggregate("blocks", F.lit(0).cast("long"), lambda acc, b: acc + F.when(b["share"] < limit(b), b["suspect"]).otherwise(0))
    return feats.select("doc_id", "total", suspect.alias("suspect"))


def spam(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lack: float = LACK, lang: str | None = None) -> DataFrame:
    """doc_ids of spam pages: suspect text makes up more than half of their characters."""
    return scored(docs, doc_id, text, lack, lang).filter("suspect * 2 > total").select("doc_id")
