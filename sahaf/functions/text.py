"""Text functions: cleaning, canonical forms, fingerprints, urls."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable
from difflib import SequenceMatcher
from hashlib import sha256
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query keys that only track.
TRACKING = ("dclid", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid", "yclid")
BLOCK_TAGS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "article", "section", "footer", "header", "nav", "title"}


def turkish_lower(x: Column | str) -> Column:
    return F.lower(F.translate(x, "Iİ", "ıi"))


def tokens(x: Column | str) -> Column:
    """Numbers with their separators, and words with an apostrophe's suffix, of text that is clean."""
    return F.regexp_extract_all(turkish_lower(x), F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)*|\p{L}+(?:['’]\p{L}+)?"), F.lit(0))


#: What becomes a blank, and what goes.
PLAIN = dict.fromkeys(map(ord, "\u00a0\t\r\f\v"), " ") | dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), 0x2060, 0xFEFF])


def link_text(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(turkish_lower(x), r"[^\p{L}\p{N}_]+", " "))


class _Text(HTMLParser):
    """The text of a page, block elements on lines of their own."""

    SKIP = {"script", "style", "noscript", "template"}

    def __init__(self, skip: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.skip, self.depth, self.parts = self.SKIP | skip, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.skip
        if tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in self.skip and self.depth > 0
        if tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def strip_tags(value: str, skip: frozenset[str] = frozenset()) -> str:
    parser = _Text(skip)
    parser.feed(value)
    parser.close()
    return "".join(parser.parts)


def clean(value: str | None) -> str:
    """Readable text: entities and tags resolved, composed letters, single blanks, at most one empty line in a row."""
    text = unicodedata.normalize("NFC", html.unescape(value or ""))
    if "<" in text and ">" in text[text.index("<") :]:
        text = strip_tags(text)
    kept: list[str] = []
    for line in text.translate(PLAIN).split("\n"):
        line = " ".join(filter(None, line.split(" ")))
        if line or (kept and kept[-1]):
            kept.append(line)
    while kept and not kept[-1]:
        kept.pop()
    return "\n".join(kept)


def canonical(value: str | None) -> str:
    return " ".join(re.findall(r"[^\W_]+", unicodedata.normalize("NFC", value or "").casefold()))


def content_digest(*parts: str | None) -> str:
    return sha256("\0".join(map(canonical, parts)).encode()).hexdigest()


def features(value: str | None) -> list[str]:
    """Three-word shingles of the canonical text, or its words if there are fewer."""
    words = canonical(value).split()
    return words if len(words) < 3 else list(map(" ".join, zip(words, words[1:], words[2:], strict=False)))


#: Characters of texts that a task takes apart at once.
CHARACTERS = 1 << 20


def slices(texts: pd.Series) -> list[tuple[int, int]]:
    """(first, end) of runs of texts; what follows a run's first text has fewer than CHARACTERS characters."""
    of = np.cumsum(texts.str.len().fillna(0).to_numpy()) // CHARACTERS
    edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(texts)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def simhashes(values: Iterable[str | None]) -> np.ndarray:
    """Of each text 64 bits, one set if as many features have it as don't; a feature of several texts is hashed once."""
    known: dict[str, int] = {}
    at, size = [], []
    for v in values:
        own = [known.setdefault(f, len(known)) for f in features(v)]
        at += own
        size.append(len(own))
    digests = np.frombuffer(b"".join(sha256(f.encode()).digest()[:8] for f in known), dtype=np.uint8).reshape(-1, 8)
    n = np.array(size, dtype=np.int64)
    out = np.full(len(n), -1, dtype=np.int64)  # a text without features has all bits
    held, rows, ends = np.flatnonzero(n), np.array(at, dtype=np.int64), np.cumsum(n)
    for a in range(0, len(held), 500):
        own = held[a : a + 500]
        first, last = ends[own[0]] - n[own[0]], ends[own[-1]]
        ones = np.add.reduceat(np.unpackbits(digests[rows[first:last]], axis=1), ends[own] - n[own] - first, axis=0, dtype=np.int64)
        out[own] = np.packbits(2 * ones >= n[own][:, None], axis=1).view(">i8").ravel()
    return out


def simhash64(value: str | None) -> int:
    """The fingerprint of one text, unsigned."""
    return int(simhashes([value])[0]) % (1 << 64)


@F.pandas_udf(T.StringType())
def clean_text(x: pd.Series) -> pd.Series:
    return x.map(clean)


@F.pandas_udf(T.StringType())
def canonical_text(x: pd.Series) -> pd.Series:
    return x.map(canonical)


@F.pandas_udf(T.StringType())
def content_hash(title: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([content_digest(a, b) for a, b in zip(title, content, strict=True)])


@F.pandas_udf(T.LongType())
def simhash(x: pd.Series) -> pd.Series:
    return pd.Series(np.concatenate([simhashes(x.iloc[a:b]) for a, b in slices(x)] or [np.empty(0)]), dtype="int64")


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of matching blocks of two normalised titles."""
    norm = lambda v: " ".join(re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", (v or "").lower()))
    return pd.Series([SequenceMatcher(a=norm(x), b=norm(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _one_letter(c: str) -> str | None:
    """The letter that is left of a character's compatible form without marks, if one is left."""
    plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return plain if plain != c and len(plain) == 1 else None


#: Characters of the basic plane that are one letter without their marks, and that letter.
_MARKED = "".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0xFFFE)]) if _one_letter(c))
_PLAIN = "".join(map(_one_letter, _MARKED))


def ascii_fold(x: Column | str) -> Column:
    """Letters without their marks, the dotless i as i; characters that stand for several letters stay."""
    return F.translate(F.regexp_replace(x, r"\p{Mn}+", ""), _MARKED + "ı", _PLAIN + "i")


#: What one byte is in the encodings that texts are misread in, where they differ.
_ODD_BYTES = {b: bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_ODD = "".join(_ODD_BYTES.values())
_ODD_AS_LATIN = "".join(chr(b) for b, c in _ODD_BYTES.items() if c)
MARKS = "[ÃÂÄÅâ€™]"


def repair_mojibake(x: Column | str, ties: bool = False) -> Column:
    """Text that was UTF-8 read as a one-byte encoding, if undoing that leaves fewer odd marks; the first encoding of equals.

    Letters that are marks themselves (Ä, â, €) leave as many as they were misread as, and other scripts have none; ties
    takes these too, for texts that are known to be misread.
    """
    fewer = (lambda a, b: odd(a) <= odd(b)) if ties else (lambda a, b: odd(a) < odd(b))
    x = F.col(x) if isinstance(x, str) else x
    odd = lambda v: F.size(F.regexp_extract_all(v, F.lit(MARKS), F.lit(0)))

    def undone(latin: Column, known: Column) -> Column:
        safe = F.when(known, latin).otherwise("")
        raw = F.encode(safe, "ISO-8859-1").cast("string")
        return F.when(known & F.is_valid_utf8(raw), raw)

    as_1252 = undone(F.translate(x, _ODD, _ODD_AS_LATIN), x.rlike(rf"\A[\x00-\x7F\xA0-\xFF{_ODD}]*\z"))
    as_latin = undone(x, x.rlike(r"\A[\x00-\xFF]*\z"))
    first = F.when((F.coalesce(as_1252, F.lit("")) != "") & fewer(as_1252, x), as_1252).otherwise(x)
    return F.when((F.coalesce(as_latin, F.lit("")) != "") & fewer(as_latin, first), as_latin).otherwise(first)


def excerpt(x: Column | str, limit: int = 360) -> Column:
    """Whole sentences up to limit characters; a longer first sentence is cut at a word."""
    x = F.col(x) if isinstance(x, str) else x
    v = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "), r"\A | \z", "")
    whole = F.regexp_extract(v, rf"(?s)\A.{{0,{limit - 1}}}[.!?](?=\s)", 0)
    cut = F.concat(F.regexp_replace(F.left(v, F.lit(limit - 1)), r" [^ ]*\z", ""), F.lit("…"))
    return F.when(F.length(v) <= limit, v).when(whole != "", whole).otherwise(cut)


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ; 64 if one isn't there."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def clean_lines(x: Column | str) -> Column:
    """Lines with single blanks, without empty ones and without repeats of the line before."""
    lines = F.filter(F.transform(F.split(x, "\n"), lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != "")
    return F.array_join(F.filter(lines, lambda v, i: (i == 0) | (F.get(lines, i - 1) != v)), "\n")


def source_url(url: Column | str) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters; the others as they stand."""
    url = F.col(url) if isinstance(url, str) else url
    base = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    site = F.regexp_extract(base, r"^[^:]+://[^/]*", 0)
    query = F.regexp_extract(F.substring_index(url, "#", 1), r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(r"^utm_") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(F.lower(site), F.substring(base, F.length(site) + 1, F.lit(1 << 20)), tail)


def canonical_url(url: Column | str) -> Column:
    """source_url() with sorted parameters and without a slash at the path's end."""
    u = source_url(url)
    path, query = F.regexp_replace(F.substring_index(u, "?", 1), "/+$", ""), F.regexp_extract(u, r"\?(.*)$", 1)
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&")))


def family(url: Column, fallback: Column) -> Column:
    return F.sha2(F.when(F.coalesce(url, F.lit("")) != "", canonical_url(url)).otherwise(F.concat(F.lit("synthetic:"), fallback)), 256)


def split_of(family_id: Column) -> Column:
    """train, validation or test by the first 32 bits of a family's hash: 70, 15 and 15 of 100."""
    bucket = F.conv(F.substring(family_id, 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test")


def record_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0000", *parts), 256), 1, 20)


def has_phrase(x: Column, phrase: str) -> Column:
    """Whether the phrase stands in x on word boundaries, case aside."""
    return x.rlike(r"(?iu)(?<![\p{L}\p{N}_])" + re.escape(phrase) + r"(?![\p{L}\p{N}_])")


def turkish_amount(x: Column) -> Column:
    """1234.56 as 1.234,56 TL."""
    return F.concat(F.translate(F.format_number(x, 2), ",.", ".,"), F.lit(" TL"))


def mark_repeats(lines: Column) -> Column:
    return F.size(F.array_distinct(lines)) < F.size(lines)
