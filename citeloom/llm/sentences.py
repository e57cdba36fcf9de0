"""Sentence boundaries across languages and scripts, by semi-Markov dynamic programming over whole spans.

A text is cut at its blank lines; within a piece, places where a sentence may end are candidates (marks with the
quotes that close after them, line breaks, and spaces in scripts without marks). The best way to cover a piece by
spans between candidates is found by dynamic programming; a span is scored as a whole: how it opens, how it closes,
its length, whether both its ends stand outside of quotations and brackets, and whether it is a line of its own that
reads like a heading. So a mark inside a quotation, however many sentences that has, loses against one span around it.

No span is too long. Candidates that every best cover has, or none has, are told beforehand by bounds on what a
span's length and line can be worth (`_settled`); the programme works between the former, over what is left.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from citeloom.session import spread

#: Said of an end after which, or a beginning before which, hardly any sentence stops.
NEVER = -20.0
#: What either end of a span loses inside of a quotation or bracket.
INSIDE = 4.0
#: What a whole line that reads like a heading gains as a span.
HEADING = 6.0

# Abbreviations, without their last period, in lower case.
NEVER_LAST = frozenset("""
abb approx bd bspw bzw ca cf chap cp dept dr dra eds e.g eq eqs evtl fig figs ggf gral h.c i.e ibid inkl jr lic md mme mlle mr mrs
mt nr num núm op p pp pág págs pl pr prof profa pt refs resp sog sr sra srta st sta sto tab u univ v vgl viz vol vols vs z
zzgl z.b d.h u.a p.ej s.o s.u i.d.r al د أ م ص डॉ श्री प्रो सं ดร รศ ผศ นพ พ.ศ ค.ศ
""".split())
NOT_LAST_BEFORE_NUMBER = frozenset("art cap ch col ed f ff max min no nos para ref s sec sect str t tel r".split())
MAY_BE_LAST = frozenset("etc usw usf ej etcétera u.s u.k u.s.a e.u ph.d m.d b.a m.a b.c a.d a.m p.m inc ltd corp co jan feb mar apr jun jul aug sept sep oct nov dec".split())
OPENERS = frozenset("""
the a an this that these in on for with by we our it as at after before once when while if every each no one according overall
however notably besides der die das ein eine jeder kein im nach mit wir dies es manche warum welche siehe laut le la les un une
des selon dans pour après avec ce cette nous il elle voir pourquoi el los las una según para tras con este esta véase faltan
""".split())
SAYING = re.compile(r"\w[\w'’-]*(?: \w[\w'’-]*)? (?:said|says|asked|asks|wrote|writes|noted|notes|added|adds|replied|explained|reports|reported)(?=\s*[.,;!])")
SAYING_ZH = re.compile(r"[^。！？\n]{0,12}(?:说|問|问|道|写道|問道|问道)[。！？，,]")
ORDINAL_BEFORE = frozenset("jeder jede jedes jeden jedem am der die das dem den des im vom zum beim bis ab seit und".split())

MARKS_WIDE = "。！？｡．؟۔।॥։።။។།"
OPENING = "“„«‹「『（([【《〈"
CLOSING = "”»›」』）)]】》〉"
_END = re.compile(r"(?:[.!?…]+|[" + MARKS_WIDE + r"])+")
_CLOSERS = re.compile(r"(?:[”’»›」』）)\]】》〉]|[\"'](?!\w)|“(?!\w)|\s»)+")
_BLANK_LINE = re.compile(r"[^\S\n]*(?:\r\n?|\n| | |\x85)(?:[^\S\n]*(?:\r\n?|\n| ))+\s*|[^\S\n]* \s*")
_NEWLINE = re.compile(r"\r\n?|\n| |\x85")
_MARKER = re.compile(r"[^\S\n]*(?:[-*•‣◦▪–—·●○]|\(?\d{1,3}[.)]|#{1,6})[^\S\n]+\S")
_UNMARKED = re.compile(r"[ก-໿]")
_NUMBER_OR_LATIN = re.compile(r"[0-9٠-٩०-९๐-๙A-Za-zÀ-ɏḀ-ỿ]")


def _word_before(text: str, end: int, start: int) -> str:
    at = end
    while at > start and not text[at - 1].isspace() and text[at - 1] not in "\"“„«‹(（[「『¿¡,;:":
        at -= 1
    return text[at:end]


_GERMAN = re.compile(r"\b(?:der|die|das|und|ein|eine|obwohl|nach|wird|mit|den)\b")


class _Piece:
    """The candidates of one piece [start, end) of a text."""

    def __init__(self, text: str, start: int, end: int, width: int, wrapped: bool):
        self.text, self.start, self.end, self.width, self.wrapped = text, start, end, width, wrapped
        self.german: bool | None = None
        #: place after which a span ends -> what is said for ending there and opening after it
        self.cuts: dict[int, float] = {}
        #: place at the end of a line that may be a heading -> the line's first letter
        self.headings: dict[int, int] = {}
        self._marks()
        self._lines()
        self._spaces()

    def _next(self, at: int) -> int:
        return _first_letter(self.text, at, self.end)

    def _open(self, at: int, closed_quote: bool, spaced: bool, wide: bool, bracketed: bool = False, wide_mark: bool = False) -> float:
        """What is said for a span opening at `at`."""
        text = self.text
        ch = text[at]
        if ch in ",;:)]}”»›」』）】》〉、，；：%" or unicodedata.category(ch) in ("Pe", "Pf"):
            return NEVER
        k = at
        while k < self.end and (text[k] in OPENING or text[k] in "\"'‘¿¡*-–—   "):
            k += 1
        first = text[k] if k < self.end else ch
        rest = text[at : at + 60]
        if closed_quote:
            if not spaced and not wide and first.isalnum() and k == at:
                return NEVER
            if wide and (rest.startswith("と") or rest.startswith("って") or "가" <= ch <= "힣" and not spaced):
                return NEVER
            if SAYING.match(rest) and re.match(r"\w+", rest).group().lower() not in OPENERS or (wide and SAYING_ZH.match(rest)):
                return NEVER
        if first.islower() and not wide_mark:
            return NEVER if closed_quote or bracketed else -2.0
        score = 1.0 if first.isupper() or first.isdigit() or k > at else 0.7
        word = re.match(r"\w+", text[k : k + 20])
        return score + (0.5 if word and word.group().lower() in OPENERS else 0.0)

    def _close(self, at: int, stop: int) -> float:
        """What is said for a span closing with the mark [at, stop)."""
        text, mark = self.text, self.text[at:stop]
        if mark[-1] in MARKS_WIDE and not (mark[-1] == "．"):
            return 4.0
        if "!" in mark or "?" in mark:
            return 3.5
        if "…" in mark or len(mark) > 1:
            return 1.2
        # a single period
        after = text[stop : stop + 1]
        word = unicodedata.normalize("NFKC", _word_before(text, at, self.start))
        if after.isdigit() and (not word or word[-1].isdigit()):
            return NEVER
        head, _, tail = word.rpartition(".")
        if len(head) > 3 and tail and head[-1].islower():
            word = tail  # the mark before it had no blank after it
        low = word.lower().lstrip("'‘")
        if _UNMARKED.search(word[-1:] or " "):
            return NEVER
        if not word:
            return -1.0 if not text[max(self.start, at - 1) : at].strip() else 2.5
        if low in NEVER_LAST or word == "Ms" or low in NOT_LAST_BEFORE_NUMBER and text[stop : stop + 3].strip()[:1].isdigit():
            return -6.0
        if low in MAY_BE_LAST:
            return 0.2 if low in ("etc", "usw", "usf") else -2.5
        if len(word) == 1 and word.isalpha() and (word.isupper() or word.islower()):
            return -5.0
        if "." in word and not re.search(r"\d", word) and all(len(p) <= 2 for p in word.split(".")):
            return -3.0
        if word.isdigit():
            if not text[self._line_start(at - len(word)) : at - len(word)].strip() and len(word) <= 3:
                return NEVER  # numbers a line
            if len(word) <= 2:
                gap = at - len(word)
                while gap > self.start and text[gap - 1].isspace():
                    gap -= 1
                before = unicodedata.normalize("NFKC", _word_before(text, gap, self.start)).lower()
                if before in ORDINAL_BEFORE or not before and self._german():
                    return -4.0
            return 2.5
        return 3.0 + (0.4 if len(word) >= 4 else 0.0)

    def _german(self) -> bool:
        if self.german is None:
            self.german = bool(_GERMAN.search(self.text, self.start, self.end))
        return self.german

    def _line_start(self, at: int) -> int:
        return max(self.start, max(self.text.rfind("\n", self.start, at), self.text.rfind("\r", self.start, at)) + 1)

    def _marks(self) -> None:
        text = self.text
        for m in _END.finditer(text, self.start, self.end):
            at, stop = m.span()
            close = self._close(at, stop)
            closers = _CLOSERS.match(text, stop, self.end)
            quoted = bool(closers) and bool(re.search(r"[\"”’»›」』“]", closers.group()))
            cut = closers.end() if closers else stop
            after = self._next(cut)
            if after >= self.end:
                continue
            spaced, wide = after > cut, text[stop - 1] in MARKS_WIDE or "　" < text[after] < "ힰ"
            if not spaced and not closers and text[stop - 1] not in MARKS_WIDE:
                # no blank after the mark: only between a word and a capital, a digit or a script without case
                before, ch = text[max(self.start, at - 2) : at], text[after]
                if text[stop - 1] == ".":
                    follows = ch in OPENING or ch.isupper() and (text[after + 1 : after + 2].islower() or text[after + 1 : after + 2].isspace() or text[after + 1 : after + 3] == ". ")
                    if not (follows and len(before) == 2 and before[0].isalnum() and (before[1].islower() or before[1].isdigit() or before[1] in ")]%")) and not (len(before) == 2 and "가" <= before[-1] <= "힣"):
                        close = NEVER
                    close -= 1.0
                elif not (ch.isalnum() or ch in OPENING):
                    close = NEVER
            if close > NEVER:
                close += self._open(after, quoted, spaced, wide, bool(closers), text[stop - 1] in MARKS_WIDE)
            self.cuts[cut] = close

    def _lines(self) -> None:
        text = self.text
        breaks = [m for m in _NEWLINE.finditer(text, self.start, self.end)]
        begin = self.start
        for m in breaks:
            line = text[begin : m.start()]
            cut = begin + len(line.rstrip())
            after = self._next(m.end())
            if line.strip() and after < self.end:
                here, there = bool(_MARKER.match(text, begin, m.start())), bool(_MARKER.match(text, m.end(), self.end))
                short = len(line.strip()) < 0.62 * self.width
                last, first = text[cut - 1], text[after]
                ended = self.cuts.get(cut, NEVER) > NEVER / 2 or last in "!?…" or last in MARKS_WIDE
                if _UNMARKED.match(last) or _UNMARKED.match(first):
                    self.cuts[cut] = max(self.cuts.get(cut, 0.0), 5.0)
                elif there and (text[m.end() : after + 1].strip() in "-*•‣◦▪·●○#" or ended or here or short or last == ":"):
                    self.cuts[cut] = max(self.cuts.get(cut, 0.0), 6.0)
                elif here and not first.islower() and (short or first.isupper() or first in OPENING + "\""):
                    self.cuts[cut] = max(self.cuts.get(cut, 0.0), 5.0)
                elif self.cuts.get(cut, NEVER) <= NEVER / 2:
                    opens = line.strip()[0]
                    heading = not self.wrapped and short and (opens.isupper() or opens.isdigit() or not opens.islower() and opens.isalpha()) and (first.isupper() or first.isdigit() or not first.islower() and (first.isalpha() or first in OPENING)) and last not in ",;:-–" and last.isalnum()
                    self.cuts[cut] = -4.0
                    if heading and len(line.split()) <= 8 and line.strip().lower() not in OPENERS:
                        self.headings[cut] = self._next(begin)
            begin = m.end()

    def _spaces(self) -> None:
        """In scripts without sentence marks a space ends a sentence, unless it stands beside a number or a Latin word."""
        text = self.text
        if not _UNMARKED.search(text, self.start, self.end):
            return
        for m in re.compile(r"[^\S\r\n]+").finditer(text, self.start, self.end):
            at, after = m.span()
            if at == self.start or after >= self.end or text[after] in "\r\n":
                continue
            left = next((c for c in reversed(text[max(self.start, at - 3) : at]) if c.isalnum() or unicodedata.category(c) in ("Mn", "Mc")), " ")
            right = next((c for c in text[after : after + 3] if c.isalnum()), " ")
            if _UNMARKED.match(left) and _UNMARKED.match(right) and not _NUMBER_OR_LATIN.match(left) and not _NUMBER_OR_LATIN.match(right):
                self.cuts[at] = max(self.cuts.get(at, 0.0), 5.0)


_QUOTE = re.compile(r'["„“”«»‹›「」『』()（）\[\]【】《》〈〉]')
_PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", '"': '"', "»": "«", "›": "‹"}


def quotations(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(place of the opening mark, place of the closing one) of the outermost quotations and brackets in [start, end).

    Which side a straight quote or a guillemet is on is told by the blanks beside it. A mark without its partner means nothing.
    """
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    for m in _QUOTE.finditer(text, start, end):
        ch, at = m.group(), m.start()
        free_left = at == start or text[at - 1].isspace() or text[at - 1] in OPENING
        free_right = at + 1 == end or text[at + 1].isspace() or not text[at + 1].isalnum() and text[at + 1] not in OPENING
        waiting = {c for c, _ in stack}
        if ch == '"':
            opens = ch not in waiting if free_left == free_right else free_left
        elif ch == "“":
            opens = "“" not in waiting
        elif ch in "»›":
            opens = free_left and not free_right
        elif ch in "«‹":
            opens = not (free_right and not free_left)
        else:
            opens = ch in _PAIRS
        if ch == "”" and "”" not in waiting and "“" in waiting:
            ch = "“"  # the other close of a low quote
        if opens:
            stack.append((_PAIRS[ch], at))
        elif ch in waiting:
            while stack[-1][0] != ch:
                stack.pop()
            found.append((stack.pop()[1], at))
    outer: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _length_score(n: int) -> float:
    return -0.25 * abs(math.log((n + 1) / 70)) - (2.0 if n < 2 else 0.0)


#: Most that two spans' lengths can be worth above that of the one they make: of lengths a <= b it is at most
#: 0.25 log((a + b + 1) / (b + 1)) <= 0.25 log 2, since no length is worth more than 0.
SPLIT_GAIN = 0.25 * math.log(2)


def _split_loss(n: int, gap: int) -> float:
    """Most that one span of up to n letters can be worth, by its length, above any two it is cut into of at least `gap` letters."""
    short = 0.25 * math.log(70 / 2) + (2.0 if gap < 2 else 0.0)
    return short + max(short, 0.25 * math.log(max(n + 1, 70) / 70))


def _settled(places: list[int], said: list[float], first: list[int] | None, headings: dict[int, int]) -> tuple[list[int], set[int]]:
    """Candidates that may be in a best cover, and those among them that must be. first: the first letter after each place.

    Taking a candidate out of a cover changes its score by minus what is said of it and at most SPLIT_GAIN, and putting
    one in by what is said and at most _split_loss, with HEADING more where a line that may be a heading ends or begins.
    """
    gap = min(b - a for a, b in zip(places, places[1:]))
    sure = _split_loss(places[-1] - places[0], gap)
    inner = range(1, len(places) - 1)
    if not headings:
        return [k for k in inner if said[k] > -SPLIT_GAIN], {k for k in inner if said[k] > sure}
    lines = set(headings.values())
    kept = [k for k in inner if said[k] + HEADING * ((places[k] in headings) + (first[k] in lines)) > -SPLIT_GAIN]
    return kept, {k for k in kept if said[k] > sure + HEADING}


def _best_cover(text: str, start: int, end: int, cuts: dict[int, float], headings: dict[int, int]) -> list[int]:
    """The ends of the best spans that cover [start, end)."""
    places = [start, *sorted(c for c in cuts if start < c < end), end]
    if len(places) == 2:
        return [end]
    said, inside = [0.0, *(cuts[p] for p in places[1:-1]), 0.0], quotations(text, start, end)
    at = 0
    for k in range(1, len(places) - 1):
        while at < len(inside) and inside[at][1] < places[k]:
            at += 1
        if at < len(inside) and inside[at][0] < places[k]:
            said[k] -= 2 * INSIDE
    first = [_first_letter(text, p, end) for p in places] if headings else None
    kept, sure = _settled(places, said, first, headings)
    nodes = [0, *kept, len(places) - 1]
    spots, gains = np.array([places[k] for k in nodes]), [said[k] for k in nodes]
    best, back, low = np.zeros(len(nodes)), [0] * len(nodes), 0
    for j in range(1, len(nodes)):
        if j - low == 1 and not headings:
            best[j], back[j] = best[low] + gains[j] + _length_score(int(spots[j] - spots[low])), low
        else:
            size = spots[j] - spots[low:j]
            score = best[low:j] + gains[j] - 0.25 * np.abs(np.log((size + 1) / 70)) - 2.0 * (size < 2)
            line = headings.get(int(spots[j]))
            if line is not None:
                score += HEADING * np.array([first[nodes[i]] == line for i in range(low, j)])
            i = int(np.argmax(score))
            best[j], back[j] = score[i], low + i
        if nodes[j] in sure:
            low = j
    out, j = [], len(nodes) - 1
    while j:
        out.append(int(spots[j]))
        j = back[j]
    return out[::-1]


def _first_letter(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


def _is_wrapped(text: str, width: int) -> bool:
    """Whether lines of running text are broken at a width: some line ends without a mark and the next goes on in lower case or, in scripts without case, is as long."""
    lines = [x.strip() for x in _NEWLINE.split(text)]
    for line, after in zip(lines, lines[1:]):
        if not line or not after or _MARKER.match(line + " x") or _MARKER.match(after + " x") or line[-1] in ".!?…:;,\"”»" or line[-1] in MARKS_WIDE:
            continue
        if after[0].islower() or not (after[0].isupper() or after[0].isdigit()) and len(line) > 0.6 * width:
            return True
    return False


def split_text(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in code points; end is after closing punctuation and quotes. None for null and blank texts."""
    if not text or not text.strip():
        return []
    lines = [len(x.strip()) for x in _NEWLINE.split(text)]
    width = max(lines)
    wrapped = _is_wrapped(text, width)
    out: list[tuple[int, int]] = []
    pieces, at = [], 0
    for m in _BLANK_LINE.finditer(text):
        pieces.append((at, m.start()))
        at = m.end()
    pieces.append((at, len(text)))
    for start, end in pieces:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if start == end:
            continue
        piece = _Piece(text, start, end, width, wrapped)
        begin = start
        for stop in _best_cover(text, start, end, piece.cuts, piece.headings):
            a, b = begin, stop
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            begin = stop
    return out


def sentences(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char): one row per sentence of every document.

    Null, empty and blank texts have none. Very long texts are split whole, and a sentence may be as long as its text. Repeated rows give repeated sentences; other columns are dropped. Needs no shuffle, unless the input has fewer partitions than there are cores.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc, body in zip(batch[id_column], batch[text]):
                for a, b in split_text(body):
                    ids.append(doc)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({id_column: pd.Series(ids, dtype=batch[id_column].dtype), "start_char": np.array(starts, dtype="int64"), "end_char": np.array(ends, dtype="int64")})

    kind = documents.schema[id_column].dataType.simpleString()
    return spread(documents.select(id_column, text)).mapInPandas(split, f"`{id_column}` {kind}, start_char long, end_char long")
