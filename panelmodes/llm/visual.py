"""One consistent form for text that looks the same but is stored with different characters.

A text is first reduced to its *visible form*: invisible characters go, all spaces become one kind, full-width signs, letter ligatures and
Roman-numeral signs become plain letters, accents are split off canonically, and every letter that has a twin in another script
becomes the group's first letter. Two texts look the same exactly if their visible forms are equal. The consistent spelling is then
chosen from the visible form alone, token by token: the scripts that can write each letter are intersected over the token; a single script
left writes it, a whole-script confusable (several left) follows the nearest decided token, and a truly mixed token keeps each letter in
the only script that has it. So the final form is equal for texts that look the same, and different for texts that don't.

What can be seen stays: letter case, accents, raised or circled signs, the sign for 'number', dashes of different length, digits, line breaks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmodes.session import cut

# Letters that look alike, each line Latin (or, where Latin has none, Cyrillic), Cyrillic, Greek; '-' stands for none.
TWINS = """
A А Α
B В Β
C С Ϲ
E Е Ε
G Ԍ -
H Н Η
I І Ι
J Ј Ϳ
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
Q Ԛ -
S Ѕ -
T Т Τ
W Ԝ -
X Х Χ
Y У Υ
Z - Ζ
a а -
c с ϲ
d ԁ -
e е -
h һ -
i і -
j ј ϳ
l ӏ -
o о ο
p р ρ
q ԛ -
s ѕ -
u - υ
v ѵ ν
w ԝ -
x х -
y у -
- Г Γ
- П Π
- Ф Φ
- к κ
"""

# Characters that show nothing in Latin, Cyrillic and Greek text (soft hyphen, zero-width signs, direction marks, selectors).
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200E, 0x200F, *range(0x202A, 0x202D), *range(0x2060, 0x2065), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), 0xFEFF]
LINE_ENDS = [0x0B, 0x0C, 0x85, 0x2028, 0x2029]

LATIN, CYRILLIC, GREEK = 1, 2, 4


def _tables() -> tuple[dict[int, str | None], dict[int, dict[int, str]], dict[str, int]]:
    first: dict[int, str | None] = dict.fromkeys(INVISIBLE)
    spell: dict[int, dict[int, str]] = {LATIN: {}, CYRILLIC: {}, GREEK: {}}
    scripts: dict[str, int] = {}
    for line in TWINS.split("\n"):
        if not line:
            continue
        own = dict(zip((LATIN, CYRILLIC, GREEK), line.split()))
        own = {s: c for s, c in own.items() if c != "-"}
        head = next(iter(own.values()))
        scripts[head] = sum(own)
        for script, letter in own.items():
            first[ord(letter)] = head
            spell[script][ord(head)] = letter
    first[0x4C0] = "I"  # the palochka has no case of its own
    for code in range(0x20, 0x3001):
        if unicodedata.category(chr(code)) == "Zs":
            first[code] = " "
    first[0x3000] = " "
    first |= dict.fromkeys(LINE_ENDS, "\n")
    first |= {0x2010: "-", 0x2011: "-"}
    return first, spell, scripts


_FIRST, _SPELL, _SCRIPTS = _tables()
# By rule: full-width signs lie at a fixed distance from ASCII; ligatures and Roman-numeral signs decompose by Unicode.
_EARLY = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFB00, 0xFB07), *range(0x2160, 0x2180), 0xB5)}
# Joiners shape Arabic, Indic and emoji sequences and stay there.
_JOINERS = re.compile("(?<![\u0600-࿿☀-➿\ufe0f\U0001f000-\U0001faff])[\u200c\u200d]+")
_MARKS = "\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
_TOKEN = re.compile(f"[^\\W\\d_](?:[^\\W\\d_]|[{_MARKS}])*")
_TAIL = re.compile("[ \t]+(?=\n|\\Z)")
_ROMAN = re.compile("(?=.*[IV])[IVX]+")


_DROP = dict.fromkeys(INVISIBLE)  # before decomposition, so that marks meet their letters
_PLAIN = {c: t for c, t in _FIRST.items() if t in (" ", "\n", "-")}
#: Characters outside words that need care; most texts have few of them.
_RARE = re.compile("[" + "".join(re.escape(chr(c)) for c in (*_EARLY, *_DROP, *_PLAIN, 0x200C, 0x200D, 0x0D) if c not in (0x20, 0x2D)) + "]")


def _cleaned(text: str) -> str:
    """Without invisible characters, with one kind of space and line end, and with plain letters for full-width forms and ligatures."""
    if not text.isascii() and _RARE.search(text):
        text = _JOINERS.sub("", text).translate(_EARLY).translate(_DROP)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if _RARE.search(text):
        text = text.translate(_PLAIN)
    return _TAIL.sub("", text) if "\n" in text or text[-1:] in (" ", "\t") else text


def visible_form(text: str) -> str:
    """The text reduced to what a reader sees; equal exactly for texts that look the same."""
    return unicodedata.normalize("NFD", _cleaned(text)).translate(_FIRST)


def _of_letter(letter: str) -> int:
    """Scripts that can write a letter of a visible form; 0 for letters outside the three scripts."""
    known = _SCRIPTS.get(letter)
    if known is not None:
        return known
    code = ord(letter)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return LATIN
    if 0x400 <= code < 0x530 or 0x2DE0 <= code < 0x2E00 or 0xA640 <= code < 0xA6A0:
        return CYRILLIC
    return GREEK if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000 else 0


def resolved_scripts(token: str) -> tuple[int, int]:
    """(intersection, majority) of a token of a visible form: the scripts that write all of it, and the script most of its one-script letters need."""
    left, tally = LATIN | CYRILLIC | GREEK, {LATIN: 0, CYRILLIC: 0, GREEK: 0}
    for letter in token:
        if "\u0300" <= letter <= "\u036f":
            continue
        own = _of_letter(letter)
        if not own:
            continue
        left &= own
        if own in tally:
            tally[own] += 1
    return left, max(tally, key=lambda s: (tally[s], -s))


class Speller:
    """Chooses the consistent spelling; keeps what it found out about words, up to ``limit`` of them."""

    def __init__(self, limit: int = 200_000) -> None:
        self.limit, self.known, self.written = limit, {}, {}

    def word(self, word: str) -> tuple[str, int]:
        """The word's visible form and its script, or less than 1 (minus the scripts it can have) if its neighbours have to decide."""
        seen = unicodedata.normalize("NFD", word).translate(_FIRST)
        left, most = resolved_scripts(seen)
        if left in (LATIN, CYRILLIC, GREEK):
            script = left
        elif not left:
            script = most
        else:
            script = LATIN if _ROMAN.fullmatch(seen) else -left
        if len(self.known) >= self.limit:
            self.known.clear()
        self.known[word] = seen, script
        return seen, script

    def spelled(self, key: tuple[str, int]) -> str:
        if len(self.written) >= self.limit:
            self.written.clear()
        got = self.written[key] = unicodedata.normalize("NFC", key[0].translate(_SPELL[key[1]]))
        return got

    def form(self, text: str) -> str:
        """The one form of all texts that look like ``text``."""
        text = _cleaned(text)
        known, written = self.known, self.written
        found = list(_TOKEN.finditer(text))
        words = [known.get(m.group()) or self.word(m.group()) for m in found]
        choice = [s for _, s in words]
        if found and min(choice) < 1:
            last = 0
            for i, s in enumerate(choice):  # the nearest decided word before ...
                if s > 0:
                    last = s
                elif -s & last:
                    choice[i] = last
            last = 0
            for i in range(len(choice) - 1, -1, -1):  # ... else after
                s = choice[i]
                if s > 0:
                    last = s
                else:
                    choice[i] = last if -s & last else (LATIN if -s & LATIN else CYRILLIC)
        out, at = [], 0
        for m, w, s in zip(found, words, choice):
            key = (w[0], s)
            start = m.start()
            if start > at:
                out.append(text[at:start])
            out.append(written.get(key) or self.spelled(key))
            at = m.end()
        out.append(text[at:])
        return unicodedata.normalize("NFC", "".join(out))


@F.pandas_udf(T.StringType())
def _forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    speller = Speller()
    for texts in batches:
        yield texts.map(lambda t: None if t is None else speller.form(t))


def visual_forms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, form): the consistent form of every text. NULL stays NULL, empty stays empty; whole texts, whatever their length."""
    return documents.select(F.col(key).alias(key), F.col(text).alias("text"), _forms(F.col(text)).alias("form"))


CHUNK = 2_000  # documents of one spelling that meet another's in one key


def look_alike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b): pairs that look the same but are stored differently, a < b.

    Only hashes of 256 bits are shuffled. Rows are first grouped by stored text; pairs are formed between the different
    spellings of a form and then expanded to their documents, so that equal copies are never compared with each other.
    NULL ids, NULL and empty texts are left out, also texts of which nothing is visible. The rows are as many as the pairs; ``look_alike_classes`` says the same in a row per document.
    """
    forms = visual_forms(documents, key, text).where(F.col(key).isNotNull() & F.expr("text IS NOT NULL AND text <> '' AND form <> ''"))
    hashed = forms.select(F.col(key).alias("id"), F.sha2("form", 256).alias("form"), F.sha2("text", 256).alias("raw"))
    hashed = cut(hashed)  # texts are read and normalised once
    spellings = hashed.select("form", "raw").distinct()
    several = spellings.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    members = cut(hashed.join(several, "form", "left_semi"))
    # A spelling of very many documents is parted, so that no task forms more than CHUNK squared pairs of one key.
    spelled = cut(members.groupBy("form", "raw").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")))
    parted = cut(members.join(spelled, ["form", "raw"]).select("form", "raw", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id"))
    side = lambda s: spelled.select("form", F.col("raw").alias(f"raw_{s}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{s}"))
    both = side("a").join(side("b"), "form").where("raw_a < raw_b")
    ids = lambda s: parted.select("form", F.col("raw").alias(f"raw_{s}"), F.col("part").alias(f"part_{s}"), F.col("id").alias(s))
    pairs = both.join(ids("a"), ["form", "raw_a", "part_a"]).join(ids("b"), ["form", "raw_b", "part_b"]).select(F.col("a").alias("x"), F.col("b").alias("y"))
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def look_alike_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, documents, spellings): the class of texts that look the same, named by its smallest id.

    NULL ids and texts form no class and are left out; empty texts are one class.
    """
    hashed = visual_forms(documents, key, text).where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).alias("doc_id"), F.sha2("form", 256).alias("form"), F.sha2("text", 256).alias("raw"))
    hashed = cut(hashed)
    spelled = hashed.groupBy("form", "raw").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = spelled.groupBy("form").agg(F.min("least").alias("class_id"), F.sum("n").alias("documents"), F.count("*").alias("spellings"))
    return hashed.join(classes, "form").select("doc_id", "class_id", "documents", "spellings")
