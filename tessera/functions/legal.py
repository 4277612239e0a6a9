"""Arabic legal text: ordinals, articles, identities, dates, references and citations.

Extraction needs positions, which SQL's regular expressions don't give, so it runs
in Python over Arrow batches with ``re``. Each function here is a plain function of
a text; ``legal_columns`` applies them to a table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .text import EASTERN_DIGITS, WESTERN_DIGITS

_DIGITS = str.maketrans(EASTERN_DIGITS, WESTERN_DIGITS)
_MARKS = re.compile("[\u064b-\u065f\u0670\u0640]")

# Arabic ordinals from 1 to 10, the tens, and the word that joins them.
ONES = ["الأولى", "الثانية", "الثالثة", "الرابعة", "الخامسة", "السادسة", "السابعة", "الثامنة", "التاسعة", "العاشرة"]
TENS = {20: "العشرون", 30: "الثلاثون", 40: "الأربعون", 50: "الخمسون", 60: "الستون", 70: "السبعون", 80: "الثمانون", 90: "التسعون"}
FIRST_OF_TENS = "الحادية"
TEEN = "عشرة"


def _ordinals() -> dict[str, int]:
    """Ordinal words for 1 to 99, built by the rule of the language."""
    table = {w: i + 1 for i, w in enumerate(ONES)}
    joined = [FIRST_OF_TENS, *ONES[1:9]]
    table |= {f"{w} {TEEN}": 11 + i for i, w in enumerate(joined)}
    for ten, word in TENS.items():
        table[word] = ten
        table |= {f"{w} و{word}": ten + 1 + i for i, w in enumerate(joined)}
    return table


ORDINALS = _ordinals()


def western(s: str) -> str:
    return s.translate(_DIGITS)


def bare(s: str) -> str:
    """Compatibility form without marks and tatweel."""
    return _MARKS.sub("", unicodedata.normalize("NFKC", s))


def search_form(s: str) -> str:
    """Decomposed, without marks, with one form for each letter family."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).replace("\u0640", "")
    return plain.translate(str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه"}))


def ordinal(words: str) -> int:
    """The number an ordinal names, or 0."""
    return ORDINALS.get(" ".join(words.split()), 0)


_WORDS = "|".join(re.escape(w).replace("\\ ", r"\s+") for w in sorted(ORDINALS, key=len, reverse=True))
_ARTICLE = re.compile(rf"(?:^|\n)[ \t]*المادة\s*[/(\-:]?\s*(?:(?P<n>[\d٠-٩۰-۹]+)|(?P<w>{_WORDS}))\s*(?P<s>مكرر(?:ة)?)?")
SHORT_BODY = 10


def articles(text: str | None) -> list[tuple[str, str]]:
    """(number, body) of each article: a body goes to the next heading, and short ones are skipped."""
    text = text or ""
    found = list(_ARTICLE.finditer(text))
    out = []
    for m, after in zip(found, [*found[1:], None][: len(found)], strict=True):
        n = str(int(western(m["n"]))) if m["n"] else str(ordinal(m["w"]))
        body = text[m.end() : after.start() if after else len(text)].strip(" \n\t:/-).")
        if len(body) >= SHORT_BODY:
            out.append((n + (" مكرر" if m["s"] else ""), body))
    return out


def article_range(text: str | None) -> tuple[int, int] | None:
    """The first and the greatest article number that a text names in digits."""
    numbers = [int(western(x)) for x in re.findall(r"المادة\s*[/(]?\s*([\d٠-٩۰-۹]+)", text or "")]
    return (numbers[0], max(numbers)) if numbers else None


# Kinds of instruments, without articles; a historic name stands for the same kind.
KINDS = {
    "مرسوم تشريعي": "legislative_decree", "مرسوم اشتراعي": "legislative_decree", "قانون أساسي": "basic_law", "قانون": "law", "مرسوم": "decree", "قرار جمهوري": "presidential_decision",
    "قرار": "decision", "تعميم": "circular", "نظام داخلي": "bylaws", "نظام": "regulation", "تعليمات تنفيذية": "executive_instructions", "تعليمات": "instructions",
}
_KIND = "|".join(re.escape(k).replace("\\ ", r"\s+(?:ال)?").replace("ي", "[يى]") for k in sorted(KINDS, key=len, reverse=True))
_NAMED = re.compile(rf"(?:ال)?({_KIND})")
_HEAD = re.compile("|".join(sorted({k.split()[0] for k in KINDS})))
_ISSUED = re.compile(r"الصادر[ةه]?\s+ب")
# The most characters between a kind and its number, and between the number and its year.
GAP, YEAR_GAP = 30, 20
_NUMBER = re.compile(rf"(\D{{0,{GAP + 8}}}?)[/(]?\s*(\d+)")
_YEAR = re.compile(rf"\D{{0,{YEAR_GAP}}}?(?:(?:لل?عام|لل?سنة|عام|سنة)\s*/?\s*(\d{{4}})|(?:ب?تاريخ|المؤرخ\s+في)\s*(?:\d{{1,2}}\s*/\s*\d{{1,2}}\s*/\s*(\d{{4}})|(\d{{4}})\s*/\s*\d{{1,2}}\s*/\s*\d{{1,2}}))")
_SLASH, _DASH = re.compile(r"\s*/\s*(\d{4})(?!\d)"), re.compile(r"\s*[-–—]\s*(\d{4})(?!\d)")
FIRST_YEAR, LAST_YEAR = 1920, 2100


def mentions(text: str, title: bool = False) -> list[tuple[str, int, int, int, int]]:
    """(kind, number, year, start, end) of the instruments that a text names, in order.

    A name is a kind, a gap, a number and a year. A gap that names another instrument
    has that one's number, unless it says that the first was issued by it. In titles a
    year may follow a slash or a dash directly; elsewhere only after the word "number"
    and a slash, as such pairs stand for other things in running text.
    """
    plain, out, at = western(text), [], 0
    for m in _NAMED.finditer(plain):
        number = _NUMBER.match(plain, m.end())
        if m.start() < at or not number:
            continue
        gap, marked = number[1], "رقم" in number[1]
        if len(gap.replace("رقم", "")) > GAP + 2 or (_HEAD.search(gap) and not _ISSUED.search(gap)):
            continue
        year = _YEAR.match(plain, number.end()) or (_SLASH.match(plain, number.end()) if title or marked else None) or (_DASH.match(plain, number.end()) if title else None)
        if not year:
            continue
        kind = KINDS[" ".join(w.removeprefix("ال").replace("ى", "ي") for w in m[1].split())]
        n, y = int(number[2]), int(next(filter(None, year.groups())))
        if n > 0 and FIRST_YEAR <= y <= LAST_YEAR:
            out.append((kind, n, y, m.start(), year.end()))
            at = year.end()
    return out


def identity(title: str | None, text: str | None = None) -> str | None:
    """``kind:number:year`` from the title, else from the first 500 characters of the text."""
    for part, is_title in ((title or "", True), ((text or "")[:500], False)):
        if found := mentions(bare(part), is_title):
            return ":".join(map(str, found[0][:3]))
    return None


def references(text: str | None) -> list[tuple[str, int, int]]:
    """(key, start, end) of each distinct instrument a text names, at its first place."""
    found: dict[str, tuple[int, int]] = {}
    for kind, n, y, start, end in mentions(text or ""):
        found.setdefault(f"{kind}:{n}:{y}", (start, end))
    return [(k, a, b) for k, (a, b) in found.items()]


# Verbs of repeal and of amendment, parts of a law, and the closing clause that repeals whatever is contrary.
REPEAL = ["يلغى", "تلغى", "يلغي", "تلغي", "ألغي", "ألغى", "الغي", "الغى", "إلغاء", "الغاء", "ملغى", "ينسخ", "تنسخ", "يوقف العمل", "توقف العمل", "ينهى العمل", "تنهى العمل"]
AMEND = ["يعدل", "تعدل", "تعديل", "معدل", "استبدال", "يستبدل", "تستبدل", "استبدل", "يستعاض", "تستعاض", "تتميم", "إضافة", "اضافة", "يضاف", "تضاف", "يحذف", "تحذف"]
PARTS = ["مادة", "مادتين", "مادتان", "مواد", "فقرة", "فقرتين", "فقرات", "بند", "بندين", "بنود", "فصل", "فصول", "باب", "جدول", "عبارة"]
CONTRARY = r"(?:يلغى|تلغى|يلغي|تلغي)\s+(?:(?:جميع|كل|كافة)\s+)?(?:ال)?(?:أحكام|احكام|نصوص|نص|حكم)\s+(?:ال)?مخالف[ةه]?"
_REPEAL, _AMEND, _CONTRARY = re.compile("|".join(REPEAL)), re.compile("|".join(AMEND)), re.compile(CONTRARY)
_PART = re.compile(rf"(?:ال)?(?:{'|'.join(PARTS)})(?![ء-ي])")
# Fixed value: the characters after a verb in which its object stands.
OBJECT = 30


def intent(context: str | None) -> str:
    """repeal, amend or cite: a verb on a part only amends, and the clause against contrary provisions repeals nothing by name."""
    plain = _CONTRARY.sub(" ", bare(context or ""))
    repeals = [bool(_PART.search(plain[m.end() : m.end() + OBJECT])) for m in _REPEAL.finditer(plain)]
    if repeals and not all(repeals):
        return "repeal"
    return "amend" if repeals or _AMEND.search(plain) else "cite"


_DATE = re.compile(r"([\d٠-٩]{1,2})\s*[/\-.]\s*([\d٠-٩]{1,2})\s*[/\-.]\s*([\d٠-٩]{4})")
_CLOSING = re.compile("دمشق|صدر|حرر")


def calendar(year: int) -> str | None:
    """The calendar a year belongs to."""
    return "gregorian" if 1920 <= year <= 2100 else "hijri" if 1338 <= year <= 1530 else None


def issue_date(text: str | None) -> tuple[str | None, str | None]:
    """The Gregorian date (ISO) and the Hijri text that close a document: the last place name counts."""
    tail = western((text or "")[-1500:])
    anchors = list(_CLOSING.finditer(tail))
    if not anchors:
        return None, None
    gregorian = hijri = None
    for m in _DATE.finditer(tail[anchors[-1].end() : anchors[-1].end() + 90]):
        day, month, year = int(m[1]), int(m[2]), int(m[3])
        if calendar(year) == "gregorian":
            made = pd.to_datetime(f"{year:04}-{month:02}-{day:02}", errors="coerce")
            gregorian = gregorian if pd.isna(made) else made.date().isoformat()
        elif calendar(year) == "hijri":
            hijri = f"{day}/{month}/{year}"
    return gregorian, hijri


def short_year(y: int) -> int:
    """A year of two or three digits in full."""
    return 2000 + y if y <= 30 else 1900 + y if y < 100 else 1000 + y if 900 <= y <= 999 else y


_NUMBERED = {"number": r"قرار\s*(?:رقم)?\s*([\d٠-٩]+)", "basis": r"أساس\s*(?:رقم)?\s*([\d٠-٩]+)"}


def citation(raw: str | None) -> dict:
    """Court, number, basis, date, key and confidence of a court citation."""
    text = western(bare(raw or ""))
    found = {k: (int(m[1]) if (m := re.search(p, text)) else None) for k, p in _NUMBERED.items()}
    date = _DATE.search(text)
    year = int(date[3]) if date else None
    court = "هيئة_عامة_نقض" if "الهيئة العامة" in text else "نقض" if "نقض" in text or found["basis"] else None
    score = 0.25 * bool(court) + 0.3 * bool(found["number"]) + 0.15 * bool(found["basis"]) + 0.2 * bool(date) + 0.1 * bool(re.search("مجلة|مجموعة|موسوعة|المحامون", text))
    keyed = court and found["number"] and (year or found["basis"])
    return found | {"court": court, "year": year, "key": "|".join(str(x or "") for x in (court, found["number"], year, found["basis"])) if keyed else None, "confidence": round(score, 2)}


# Fixed value: the characters before a reference that say what is done to it.
BEFORE = 60


def _strongest(text: str) -> str:
    """The strongest intent that a text has towards any instrument it names: repeal, then amend, then cite."""
    found = {intent(text[max(0, a - BEFORE) : a]) for _, a, _ in references(text)}
    return next((x for x in ("repeal", "amend") if x in found), "cite")


LEGAL = "doc_id long, identity string, n_articles int, first_article int, last_article int, issue_date string, hijri string, n_references int, intent string"


def legal_columns(docs: DataFrame) -> DataFrame:
    """What the functions above find in each document (doc_id, text; its first line is the title)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                span, date = article_range(text), issue_date(text)
                out.append((doc_id, identity(text.split("\n")[0], text), len(articles(text)), span and span[0], span and span[1], *date, len(references(text)), _strongest(text)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in LEGAL.split(", ")])
            yield frame.astype({c: "Int32" for c in ("n_articles", "first_article", "last_article", "n_references")})

    return docs.select("doc_id", "text").mapInPandas(run, LEGAL)


SENTENCE = re.compile(r"(?<=[.!?؟。])\s+")


def chunks(text: str | None, limit: int = 1200) -> list[str]:
    """Pieces of at most ``limit`` characters: whole lines, else sentences, else hard cuts, packed greedily."""
    text = (text or "").strip()
    if len(text) <= limit:
        return [text] if text else []
    units: list[str] = []
    for line in filter(None, (x.strip() for x in text.split("\n"))):
        for part in [line] if len(line) <= limit else SENTENCE.split(line):
            units += [part[i : i + limit] for i in range(0, len(part), limit)]
    out = [units[0]]
    for unit in units[1:]:
        if len(out[-1]) + 1 + len(unit) <= limit:
            out[-1] += " " + unit
        else:
            out.append(unit)
    return out


def chunk_documents(docs: DataFrame, limit: int = 1200) -> DataFrame:
    """doc_id, seq and text of each document's chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, n, c) for i, t in zip(batch["doc_id"], batch["text"], strict=True) for n, c in enumerate(chunks(t, limit))]
            yield pd.DataFrame(out, columns=["doc_id", "seq", "text"]).astype({"seq": "int32"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, seq int, text string")
