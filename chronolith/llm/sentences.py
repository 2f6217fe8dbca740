"""Sentence units in any script, with document-centred disambiguation of periods.

Two passes.  The first counts, over all documents, how words stand to periods and capitals (``evidence``); the
counts of all words are kept in a written table, and ``verdict`` draws from them what the corpus says of a word.
The verdicts of the ``COMMON`` most frequent words are broadcast.  Verdicts of further words are joined by word to the
documents that may ask for them (``asked``), so every count has its say at every size.  The second pass cuts each text
(``units``): blocks between blank lines, then terminators outside quotations and brackets, by the rules of the script at hand.
Whether a period ends an abbreviation, and whether the capital after it starts a sentence or a name, is decided
by the occurrences in the same document that are unambiguous, then by the corpus, then by general lists: a listed
word that the document, or else the corpus, shows to be a plain word is one ("The answer is no. The appeal fails.").  The lists also say what
kind of abbreviation a word is, one that announces what follows or one that may close a sentence.  A plain word of more than three letters in
lower case is what counts as the unambiguous end of a sentence.

Rules by script: Latin, Greek and Cyrillic capitals; danda for Devanagari, where a period never ends a unit; ideographic
terminators; Arabic question mark, no letter case; Thai, where a space ends a unit if what follows is known to
begin blocks.

Defined cases: null, empty and blank texts give no units; a block without terminators is one unit; a quotation or
bracket that is never closed in its block (or across a page header) is ignored; repeated rows give the same units.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from chronolith.runtime import materialize

BLANK = regex.compile(r"(?>\r\n|[\n\r\x85\u2028\u2029])(?:[^\S\n\r\x85\u2028\u2029]*(?>\r\n|[\n\r\x85\u2028\u2029]))+|[\f\v]|\u2029")
#: A page header or footer: a number between dashes, "page n of ...", or a line that ends in a page number.
HEADER = regex.compile(r"[-–—]\s*\d+\s*[-–—]|Page \d+ of [^\n]+")
ENUMERATOR = regex.compile(r"(?:(?:§|¶|Rn\.|Para\.|No\.|Nr\.)\s*)?(?:[\[(]?\d{1,4}[\])]?\.?|[\[(]?[A-Z][\])]?\.|[IVXLC]+\.)(?=\s)")
EVENT = regex.compile(r"[\"“”„«»()\[\]（）「」『』《》.!?…。！？؟।॥｡]")
TERMINATORS = frozenset(".!?…。！？؟।॥｡")
WIDE = frozenset("。！？｡")
OPENERS = {"“": "”", "„": "“", "«": "»", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "《": "》"}
CLOSERS = frozenset("”»)]）」』》")
BRACKETS = frozenset("()[]（）《》")
TOKEN_AFTER = regex.compile(r"[\p{L}\p{M}\xad][\p{L}\p{M}\xad'’\-]*\.?")
NUMBER = regex.compile(r"[\d.,/\-]+")
THAI = regex.compile(r"\p{Thai}")
THAI_SPACE = regex.compile(r"[^\S]+(?=[“\"(]?\p{Thai})")
THAI_WORD = regex.compile(r"\p{Thai}[\p{Thai}\p{M}]*")
#: Thai writes no spaces between words, so its first letters stand for a word.
THAI_PREFIX = 5
THAI_ASKED = regex.compile(r"(?:\s|^)[“\"(]?(\p{Thai}[\p{Thai}\p{M}]*)")
#: A period, alone or last of a row of terminators, and what may stand between it and the next word.
PERIOD = regex.compile(r"(\.)(?![.!?…。！？؟।॥｡])[”»)\]）」』》]*\s*")

# Common abbreviations of European legal and general prose.
#: They announce what follows, so no sentence ends with them.
ANNOUNCING = frozenset(
    "Mr Mrs Ms Dr Prof Pr Hon Capt Col Gen Lt Sgt Rev St Ste Mme Mlle Hr Hrn Fr Frl Sr Sra Srta Sres D Dña "
    "v vs No Nos no nos Nr Nrn n núm num art arts Art Arts cl cls s ss sec secs Sec para paras Para Paras p pp pg pág págs Abs Rn Bl S "
    "ref réf Ref Réf Ex Exh Sched Ch ch Fig fig Vol vol ed App Com Civ Adm Cf cf Vgl vgl Urt Beschl Gem gem doc approx aprox viz "
    "Harb Qy ca Cass V Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec d.A i.e e.g d.h z.B u.a i.H.v i.S.v z.T i.Ü i.V.m v.a".split()
)
TITLES = frozenset("Mr Mrs Ms Dr Prof Pr Hon Capt Col Gen Mme Mlle Hr Hrn Fr Frl Sr Sra Srta Herr Frau".split())
#: They end a phrase, so a sentence may end with them.
CLOSING = frozenset("Ltd Co Inc Corp Bros plc LLP p.m a.m etc usw m h hrs ft mm cm km S.A S.A.S S.L S.A.U S.C Cía Coop Cie Reg Rep Ct e.V Nachf m.w.N ff f Abt".split())
#: What continues a firm's name after such an abbreviation.
CONTINUING = frozenset("KG Ltd Inc Corp Co LLP GmbH AG plc Nachf SARL Coop Ct Rep S.A S.A.S S.L".split())
GERMAN_MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
#: German words that stand before an ordinal number.
ORDINAL_BEFORE = frozenset("am vom zum bis der dem den des im seit ab die das Der Am Vom Die Das Zum Seit Im".split())


#: Thai words that a phrase follows: see, for example, namely, with, and, or.
THAI_OPEN = frozenset("ดู เช่น ได้แก่ กับ และ หรือ".split())
#: Words of the lists that are also words of their own, as far as they are written like plain words.
LISTED = ANNOUNCING | CLOSING
ALSO_WORDS = frozenset(w for w in LISTED if len(w) > 1 and w.isalpha() and w.islower())


def plain(word: str) -> str:
    return word if word.isascii() else unicodedata.normalize("NFC", word.replace("\xad", ""))


# -- evidence ------------------------------------------------------------------------------
_MARKS = "“”„«»\"'()[],;:"


def evidence(text: str) -> Counter:
    """(kind, word) counts of one text. Kinds: S sentence start, M capital within a sentence, and a period followed by
    lower case or a mark (l), a digit (d) or anything else (u); p a word of the lists within a phrase, without a period; t and T are Thai block starts and words."""
    found: list[tuple[str, str]] = []
    add = found.append
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    thai = THAI.search(text) is not None
    for block in text.split("\n\n"):
        words = block.split()
        fresh, last, short, bare_word = True, "", "", ""
        for word in words:
            c = word[0]
            if c in _MARKS:
                word = word.lstrip(_MARKS)
                if not word:
                    last = c
                    continue
                c = word[0]
            if short:
                add(("l" if c.islower() else "d" if c.isdigit() else "u", short))
                short = ""
            elif bare_word:
                if c.islower():
                    add(("p", bare_word))
                bare_word = ""
            if word in ALSO_WORDS:
                bare_word = word
            if c.isupper():
                bare = word.rstrip(_MARKS)
                if fresh:
                    add(("S", bare))
                elif last.islower() or last == ",":
                    add(("M", bare))
                fresh = False
            elif fresh and (c.isalpha() or c.isdigit() and word[-1].isalpha()):
                fresh = False
            if thai and "\u0e00" <= c <= "\u0e7f":
                add(("T", word[:THAI_PREFIX]))
                if last == "":
                    add(("t", word[:THAI_PREFIX]))
            elif thai and last == "" and not c.isalpha():  # the number of the paragraph
                continue
            last = word[-1]
            if last == ".":
                size = len(word)
                if c.isalpha():
                    short = word[:-1]
                if size > 4 and word[:-1].islower():
                    fresh = True
            elif last in "?!":
                fresh = True
            elif last in ",;:" and word[-2:-1] == "." and c.isalpha():
                add(("l", word[:-2]))
    return Counter(found)


KINDS = "SMldutTp"
#: What the corpus may say of a word; no bit for a word it says nothing about.
STARTER, NAME, INNER, ABBREVIATION, BEGINS, PLAIN = 1, 2, 4, 8, 16, 32


def often(capitals: int) -> float:
    """From how many occurrences on a word is more common than any name, given all capitals within sentences."""
    return max(20, 0.001 * capitals)


def verdict(word: str, n: tuple[int, ...], least: float) -> int:
    """What the counts ``n`` of a word, in the order of ``KINDS``, say of it; ``least`` is ``often`` of the corpus."""
    s, m, low, dig, up, block, thai, word_alone = n
    bits = 0
    if s > 1 or m > 1:  # once may be the very occurrence in question
        bits |= STARTER if s >= 3 and s >= 0.3 * (s + m) else NAME
        if s + m >= least and s < 0.05 * (s + m):
            bits |= INNER
    n = low + dig + up
    if n >= 8 and low + dig >= (0.3 if len(word) < 4 or "." in word else 0.6) * n and (low + dig > s + m or not word[0].isupper()):
        bits |= ABBREVIATION
    if word_alone >= 20 and word_alone > n and low < 0.05 * max(n, 1):
        bits |= PLAIN
    if block >= 2 and block >= 0.08 * max(thai, 1):
        bits |= BEGINS
    return bits


class Known:
    """What the corpus says about words."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.starts: dict[str, bool] = {}
        #: Common words, more than any name, that never start a sentence.
        self.inner: set[str] = set()
        self.abbreviations: set[str] = set()
        #: Words of the lists that are mostly words of their own.
        self.plain: set[str] = set()
        self.thai: set[str] = set()
        least = often(sum(n for (kind, _), n in counts.items() if kind == "M"))
        self.learn((w, verdict(w, tuple(counts.get((k, w), 0) for k in KINDS), least)) for w in {w for _, w in counts})

    def learn(self, verdicts: Iterable[tuple[str, int]]) -> None:
        for w, bits in verdicts:
            if bits & (STARTER | NAME):
                self.starts[w] = bool(bits & STARTER)
            for bit, words in (INNER, self.inner), (ABBREVIATION, self.abbreviations), (PLAIN, self.plain), (BEGINS, self.thai):
                if bits & bit:
                    words.add(w)

    def forget(self, words: Iterable[str]) -> None:
        for w in words:
            self.starts.pop(w, None)
            for known in self.inner, self.abbreviations, self.plain, self.thai:
                known.discard(w)


#: From this length on the words that a text may ask for are found in one pass over it, not in one for each.
LONG = 100_000
_LOW = regex.compile(r"\.\s+(?=\p{Ll})")


class Document:
    """Evidence of one text, looked up only for the words of ambiguous periods."""

    def __init__(self, text: str, known: Known):
        self.text, self.known = text, known
        self._stands: dict[str, tuple[int, int]] = {}
        self._abbreviates: dict[str, bool] = {}
        self._alone: dict[str, bool] = {}
        self._lows: Counter | None = None
        self._places: dict[str, list[int]] | None = None
        self._thai: Counter | None = None

    def places(self, word: str) -> Iterable[int]:
        """Where a word occurs that no letter follows."""
        text, size = self.text, len(word)
        if len(text) >= LONG:
            if self._places is None:
                self._places = _occurrences(text, {w for a in asked(text) for w in (a, a + ".")})
            if word in self._places:
                return self._places[word]
        out, at = [], text.find(word)
        while at >= 0:
            if not text[at + size : at + size + 1].isalpha():
                out.append(at)
            at = text.find(word, at + 1)
        return out

    def stands(self, word: str) -> tuple[int, int]:
        """How often a capitalized word starts a block or follows !, ? or the period of a plain word, and how often it stands within a sentence."""
        if word not in self._stands:
            text, start, inside = self.text, 0, 0
            for at in self.places(word):
                i = at - 1
                while i >= 0 and text[i].isspace():
                    i -= 1
                if i < 0 or text[i] in "!?" or text.count("\n", i, at) > 1:
                    start += 1
                elif text[i] == "." and len(w := _before(text, i)) > 3 and w.isalpha() and w.islower() and not self.abbreviates(w):
                    start += 1
                elif i < at - 1 and (text[i].islower() or text[i] == ","):
                    inside += 1
            self._stands[word] = start, inside
        return self._stands[word]

    def decides(self, word: str) -> bool | None:
        """Whether a capitalized word starts sentences here, as far as this document alone can tell."""
        s, m = self.stands(word)
        return s > m if s != m and s + m >= 3 else None

    def starter(self, word: str, least: int = 1) -> bool:
        """Whether a capitalized word starts sentences rather than being a name: by this document, then by the corpus, then by what little it shows here."""
        found = self.decides(word)
        if found is not None:
            return found
        s, m = self.stands(word)
        return self.known.starts.get(plain(word), s > m and s >= least)

    def abbreviates(self, word: str) -> bool:
        """Whether a word is followed by a period and lower case in this document, at least twice and as often as by anything else."""
        if self._lows is None:
            self._lows = Counter(_word(_before(self.text, m.start()))[1] for m in _LOW.finditer(self.text))
        low = self._lows[word]
        if low < 2:
            return False
        if word not in self._abbreviates:
            text, size, n, at = self.text, len(word) + 1, 0, self.text.find(word + ".")
            while at >= 0:
                n += at == 0 or not text[at - 1].isalpha()
                at = text.find(word + ".", at + size)
            self._abbreviates[word] = 2 * low >= n
        return self._abbreviates[word]

    def alone(self, word: str) -> bool:
        """Whether a word of the lists stands in a phrase of this document without a period, as a plain word does."""
        if word not in self._alone:
            text, size = self.text, len(word)
            found, at = False, text.find(word)
            while at >= 0 and not found:
                end = at + size
                if (at == 0 or text[at - 1].isspace()) and end < len(text) and text[end].isspace():
                    while end < len(text) and text[end].isspace():
                        end += 1
                    found = end < len(text) and text[end].islower()
                at = text.find(word, at + 1)
            self._alone[word] = found
        return self._alone[word]

    def abbreviation(self, word: str, digit: bool = False) -> bool | None:
        """Whether a word before a period is an abbreviation: by this document, then by the corpus; None if both are silent.

        Before a digit it can't be told from its use as a plain word that it is none there ("no. 5" beside "no reason").
        """
        if self.abbreviates(word):
            return True
        if not digit and word in ALSO_WORDS and self.alone(word):
            return False
        if word in self.known.abbreviations:
            return True
        if not digit and word in self.known.plain:
            return False
        return None

    def begins_blocks(self, prefix: str) -> bool:
        """Whether a Thai word is known to begin blocks, here or in the corpus."""
        if prefix in self.known.thai:
            return True
        if self._thai is None:
            self._thai = evidence(self.text)
        return 0 < self._thai["t", prefix] and self._thai["t", prefix] * 4 >= self._thai["T", prefix]


def _occurrences(text: str, words: set[str]) -> dict[str, list[int]]:
    """Where each word occurs that no letter follows, for all words in one pass."""
    import ahocorasick

    found: dict[str, list[int]] = {w: [] for w in words}
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    automaton.make_automaton()
    for last, w in automaton.iter(text):
        if not text[last + 1 : last + 2].isalpha():
            found[w].append(last + 1 - len(w))
    return found


_LEAD = regex.compile(r".*[^\p{L}\p{M}\p{N}\xad.\-/,]", regex.DOTALL)


#: No word of more characters is looked at; it is no abbreviation.
WORD = 200


def _before(text: str, at: int) -> str:
    """What stands before a place up to white space."""
    before = text[max(0, at - WORD) : at]
    return before.rsplit(None, 1)[-1] if before and not before[-1].isspace() else ""


def _before_that(text: str, at: int) -> str:
    """The word before white space before a place, or before the place itself."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    return _before(text, at)


def _word(before: str) -> tuple[str, str]:
    """The word at the end of what stands before a period, as written and plain."""
    if before and not before.isalnum():
        lead = _LEAD.match(before)
        if lead:
            before = before[lead.end() :]
    word = plain(before.lstrip(".,-/"))
    if "." in word and not word[0].isdigit():
        head, _, tail = word.rpartition(".")
        if len(tail) > 1 and len(head.rpartition(".")[2]) > 1:  # a space was lost before the last word
            word = before = tail
    return before, word


def _period_ends(doc: Document, block: str, at: int, end: int, nxt: int, first: int) -> bool:
    """Whether the period at ``at`` ends a unit; ``nxt`` is the next character that is no space, ``first`` where the unit began."""
    c = block[nxt]
    spaced = nxt > end
    if c.islower() or c in ",;:)]”»":
        return False
    before = _before(block, at)
    if spaced and c.isupper() and before.isascii() and before.isalpha() and before.islower() and len(before) > 1 and before not in LISTED and before not in doc.known.abbreviations and not doc.abbreviates(before):
        return True  # a plain word, told apart without taking it to pieces
    before, word = _word(before)
    said = doc.abbreviation(word, c.isdigit()) if word else None
    if spaced and said is not True and c.isupper() and before.isalpha() and before.islower() and word not in LISTED and len(word) > 1:
        return True  # a plain word
    following = TOKEN_AFTER.match(block, nxt)
    x = plain(following[0]) if following else ""
    name = x.rstrip(".")
    if not spaced:  # a scan may have lost the space
        if c.isdigit() or c.isascii() and not c.isupper() and c != '"':
            return False
        if not c.isupper() and c not in "¿¡«„“\"":
            return c.isalpha() and len(word) > 1 and not word.isascii() and not word[-1].isdigit() and not _no_period_script(c)
        if not word or word[-1] in "ºª" or not following:
            return True
        if NUMBER.fullmatch(word):
            return len(word) > 2 and name.isalpha() and doc.starter(x)
        if said is False:
            return len(name) > 1 or not x.endswith(".") or doc.starter(x)
        if word in CLOSING:
            return (name not in CONTINUING or doc.decides(x) is True) and (doc.starter(x) or len(name) > 1 and x not in doc.known.inner)
        if len(word) < 2 or "." in word or word in ANNOUNCING:
            return False
        return len(name) > 1 or not x.endswith(".") or doc.starter(x)
    if _no_period_script(c) or word and _no_period_script(word[-1]):
        return False
    if at - first <= len(before) + 1 and word and not NUMBER.fullmatch(word) and (word in ANNOUNCING or len(word) == 1):
        return False
    if not word or word[-1] in "ºª":
        return True
    if NUMBER.fullmatch(word):
        if len(word) > 2 or not c.isupper():
            return not (c.isdigit() and len(word) <= 2)
        if name in GERMAN_MONTHS:
            return doc.decides(x) is True
        if _before_that(block, at - len(before)) in ORDINAL_BEFORE:
            return doc.starter(x)
        return True
    if len(word) == 1 and word.isalpha() and not word.islower():
        ahead = _before_that(block, at - len(before))
        if ahead.rstrip(".") in TITLES or len(ahead) == 2 and ahead[1] == ".":
            return False
        return bool(x) and name not in CONTINUING and len(name) > 1 and doc.starter(x, 3) or _abbreviated_verb(block, nxt, x)
    if said is False:
        return True
    if word in ANNOUNCING:
        return False
    if word in CLOSING or "." in word:
        if c.isdigit():
            return False
        if not x:
            return True
        if name in CONTINUING and doc.decides(x) is not True:
            return False
        if len(name) == 1 and x.endswith("."):
            return doc.starter(x) or _abbreviated_verb(block, nxt, x)
        return doc.starter(x) or word in CLOSING and (x not in doc.known.inner or doc.stands(x)[0] > 0)
    if said:
        return bool(x) and len(name) > 1 and doc.starter(x)
    return True


def _abbreviated_verb(block: str, at: int, x: str) -> bool:
    """Whether one letter and a period at a place are no initial: lower case follows, as in "V. en ce sens" or "S. auch"."""
    end = at + len(x)
    return len(x) == 2 and x[1] == "." and block[end : end + 1].isspace() and block[end:].lstrip()[:1].islower()


def _no_period_script(c: str) -> bool:
    """Scripts in which a period never ends a sentence: Devanagari, Thai."""
    return "ऀ" <= c <= "ॿ" or "฀" <= c <= "๿"


def _ideographic(c: str) -> bool:
    return "　" <= c <= "鿿" or "＀" <= c <= "￯" or "\U00020000" <= c <= "\U0003ffff"


def _ends(doc: Document, block: str, carried: list[str], ignored: frozenset[int]) -> tuple[list[int], list[tuple[str, int]]]:
    """Where units of a block end, and what is still open at its end. ``carried``: closers that an earlier block left open."""
    size = len(block)
    ends: list[int] = []
    stack: list[tuple[str, int]] = [(c, -1) for c in carried]
    m = ENUMERATOR.match(block) if not carried else None
    floor = m.end() if m else 0
    first = floor
    while first < size and block[first].isspace():
        first += 1
    done = -1
    for event in EVENT.finditer(block, floor):
        at = event.start()
        if at < done:
            continue
        c = block[at]
        if c not in TERMINATORS:
            if at in ignored:
                continue
            top = stack[-1][0] if stack else ""
            if c == top:
                opened = stack.pop()[1]
            elif c == '"':
                if any(s == '"' for s, _ in stack):
                    while stack[-1][0] != '"':
                        stack.pop()
                    opened = stack.pop()[1]
                elif at == 0 or block[at - 1].isspace() or block[at - 1] in "([—–-«“" or at + 1 < size and not block[at + 1].isspace() and block[at - 1] in ".,:;?!":
                    stack.append(('"', at))
                    continue
                else:
                    continue
            elif c == "“" and any(s == "“" for s, _ in stack):
                while stack[-1][0] != "“":
                    stack.pop()
                opened = stack.pop()[1]
            elif c == "«" and any(s == "«" for s, _ in stack):
                while stack[-1][0] != "«":
                    stack.pop()
                opened = stack.pop()[1]
            elif c == "»" and not any(s == "»" for s, _ in stack) and (at == 0 or block[at - 1].isspace()) and at + 1 < size and not block[at + 1].isspace():
                stack.append(("«", at))
                continue
            elif c in OPENERS:
                stack.append((OPENERS[c], at))
                continue
            elif any(s == c or c == "”" and s == "“" for s, _ in stack):
                while not (stack[-1][0] == c or c == "”" and stack[-1][0] == "“"):
                    stack.pop()
                opened = stack.pop()[1]
            else:
                continue
            if stack:
                continue
            # a closed quotation ends the unit if it ends like a sentence and the sentence does not go on
            inner = at - 1
            while inner > opened and (block[inner].isspace() or block[inner] in CLOSERS or block[inner] == '"'):
                inner -= 1
            if inner <= opened or block[inner] not in TERMINATORS:
                continue
            after = at + 1
            nxt = after
            while nxt < size and block[nxt].isspace():
                nxt += 1
            if nxt >= size:
                continue
            n = block[nxt]
            whole = opened <= first  # the unit began with it
            if c in BRACKETS:
                if not whole or block[inner] == "…" or not any(map(str.isspace, block[opened + 1 : at].strip())):
                    continue
            if n in TERMINATORS or n in ",;:，、；：)）" or n.islower():
                continue
            if "぀" <= n <= "ヿ" and nxt == after:  # Japanese goes on with a particle
                continue
            if _ideographic(n) and whole and nxt == after:
                continue
            if "฀" <= n <= "๿":
                continue
            if nxt == after and not (n.isupper() or _ideographic(n) or n in "¿¡«„“\""):
                continue
            ends.append(after)
            first = nxt
            continue
        # a terminator
        end = at + 1
        if c == "." and end < size and ((n := block[end]).isdigit() or n.islower() or n in ",;:"):
            continue
        while end < size and (block[end] in TERMINATORS or block[end] == " " and block[end + 1 : end + 2] == "." and block[end - 1] == "."):
            end += 1
        done = end
        if stack:
            continue
        after = end
        while after < size and block[after] in CLOSERS:
            after += 1
        nxt = after
        while nxt < size and block[nxt].isspace():
            nxt += 1
        if nxt >= size:
            continue
        n = block[nxt]
        last = block[end - 1]
        if last in WIDE:
            ok = n not in "，、；：,;:"
        elif "…" in block[at:end] or end - at > 1 and block[at:end].strip(". ") == "":
            ok = n.isupper() and nxt > after
        elif last == ".":
            ok = _period_ends(doc, block, end - 1, after, nxt, first)
        elif last in "।॥":
            ok = True
        else:
            ok = not n.islower() and n not in ",;:" and (nxt > after or n.isupper() or n in "¿¡«„“\"" or not n.isascii() and n.isalpha())
        if ok:
            ends.append(after)
            first = nxt
    if THAI.search(block):
        ends = sorted(set(ends) | set(_thai_ends(doc, block, floor, stack)))
    return ends, stack


def _thai_ends(doc: Document, block: str, floor: int, stack: list[tuple[str, int]]) -> Iterator[int]:
    begin = floor
    while begin < len(block) and block[begin].isspace():
        begin += 1
    at, quoted, bracketed = begin, 0, 0
    for m in THAI_SPACE.finditer(block, begin):
        quoted += block.count("“", at, m.start()) - block.count("”", at, m.start())
        bracketed += block.count("(", at, m.start()) - block.count(")", at, m.start())
        at = m.start()
        if quoted > 0 or bracketed > 0 or _before(block, at) in THAI_OPEN:
            continue
        if doc.begins_blocks(THAI_WORD.search(block, m.end())[0][:THAI_PREFIX]):
            yield at


def is_header(text: str, a: int, b: int) -> bool:
    if HEADER.fullmatch(text, a, b):
        return True
    i = b
    while i > a and text[i - 1].isdecimal():
        i -= 1
    mark = 1 if text[i - 1 : i] == "\t" else 3 if text[max(i - 3, 0) : i] in (" – ", " — ") else 0
    return i < b and mark > 0 and i - mark > a and text.find("\n", a, b) < 0


def units(text: str, known: Known) -> Iterator[tuple[int, int]]:
    """(start, end) of each unit, in order, without white space at either end."""
    doc = Document(text, known)
    spans, at = [], 0
    for m in BLANK.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    blocks = []
    for a, b in spans:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            blocks.append((a, b, is_header(text, a, b)))
    carried: list[str] = []
    for i, (a, b, header) in enumerate(blocks):
        if header:
            yield a, b
            continue
        block = text[a:b]
        ends, still = _ends(doc, block, carried, frozenset())
        broken = i + 1 < len(blocks) and blocks[i + 1][2]  # a page header follows
        if still and not broken:
            lost = frozenset(p for _, p in still if p >= 0)
            if lost or carried:
                ends, still = _ends(doc, block, [] if carried and any(p < 0 for _, p in still) else carried, lost)
            still = []
        carried = [c for c, _ in still]
        start = 0
        for e in ends:
            yield a + start, a + e
            start = e
            while start < len(block) and block[start].isspace():
                start += 1
        if start < len(block):
            yield a + start, b


def asked(text: str) -> set[str]:
    """All words of a text that ``units`` may ask the corpus about, whatever it answers."""
    words = {m[1][:THAI_PREFIX] for m in THAI_ASKED.finditer(text)} if THAI.search(text) else set()
    for m in PERIOD.finditer(text):
        if (c := text[m.end() : m.end() + 1]) and not c.islower():
            words.add(_word(_before(text, m.end(1) - 1))[1])
            following = TOKEN_AFTER.match(text, m.end())
            if following:
                words.add(plain(following[0]))
    words.discard("")
    return words


# -- over a corpus ------------------------------------------------------------------------------
#: So many words at most, the most frequent, have their verdicts broadcast; the rest are joined.
COMMON = 100_000


def corpus_evidence(df: DataFrame, text: str = "text") -> DataFrame:
    """word and its counts n, in the order of ``KINDS``, over all documents: a written table of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(total)
            out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([plain(w) for _, w in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], ["kind", "word", "n"])
            total.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    total.update(evidence(t))
            if len(total) > 200_000:
                yield flush()
        yield flush()

    counts = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "kind string, word string, n long")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    counts = counts.filter("word <> ''").groupBy("word").agg(*(of(kind).alias(f"n{i}") for i, kind in enumerate(KINDS)))
    return materialize(counts.select("word", F.array(*(f"n{i}" for i in range(len(KINDS)))).alias("n")), "evidence")


def verdicts(counts: DataFrame) -> DataFrame:
    """word, bits and total of every word the corpus says something about."""
    least = often(counts.agg(F.sum(F.col("n")[KINDS.index("M")])).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, bits, sum(n)) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (bits := verdict(w, tuple(n), least))]
            words, bits, total = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(bits, pa.int32()), pa.array(total, pa.int64())], ["word", "bits", "total"])

    return counts.mapInArrow(run, "word string, bits int, total long")


def _joined(rows: DataFrame, said: DataFrame, common: set[str]) -> DataFrame:
    """rows of key and text with what the corpus says of the words that each text asks for and that are not common.

    Texts are told apart by digest, so equal texts ask once and rows need no number.
    """
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            digests, words = [], []
            for digest, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = asked(t) - held if t else ()
                digests += [digest] * len(found)
                words += found
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(words, pa.string())], ["digest", "word"])

    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    wanted = rows.select("digest", "text").mapInArrow(run, "digest string, word string").distinct()
    facts = wanted.join(said.select("word", "bits"), "word").groupBy("digest").agg(F.collect_list(F.struct("word", "bits")).alias("facts"))
    return rows.join(facts, "digest", "left").select("key", "text", "facts")


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", known: Known | None = None, most: int = COMMON) -> DataFrame:
    """key, start_char, end_char of every sentence unit."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    if known is None:
        said = verdicts(corpus_evidence(df, text))
        common = [(r["word"], r["bits"]) for r in said.orderBy(F.desc("total"), "word").limit(most + 1).collect()]
        known = Known({})
        known.learn(common[:most])
        if len(common) > most:
            rows = _joined(rows, said, {w for w, _ in common[:most]})
    shared = df.sparkSession.sparkContext.broadcast(known)
    joined = "facts" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = shared.value
        for batch in batches:
            row: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            more = batch.column("facts").to_pylist() if joined else ()
            for i, t in enumerate(batch.column("text").to_pylist()):
                if t:
                    own = joined and more[i] or ()
                    facts.learn((x["word"], x["bits"]) for x in own)
                    for a, b in units(t, facts):
                        row.append(i)
                        starts.append(a)
                        ends.append(b)
                    facts.forget(x["word"] for x in own)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row, pa.int32())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["key", "start_char", "end_char"])

    out = rows.mapInArrow(run, f"key {dict(df.dtypes)[key]}, start_char int, end_char int")
    return out.withColumnRenamed("key", key)
