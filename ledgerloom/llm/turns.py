"""Call transcripts into ordered speaker turns with canonical names, clean text and repaired clock times."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import mojibake

TIME = r"(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
MARK = re.compile(rf"^\s*(?:[\[(<{{]\s*({TIME})\s*[\])>}}]|({TIME}))(?:\s*(?:[-–—|:]+(?=\s|$)))?\s*")
DASH = re.compile(r"\s+(?:—|–|--+|-)\s+")
PREFIX = re.compile(r"^[QA]\s*(?:[-–—:.]|--)\s+(?=\S)")
HEADER = re.compile(
    r"^(?:\W*)(?:(?:prepared|opening|closing|management)\s+(?:remarks|comments|discussion(?: section)?)|presentation|(?:the )?(?:q\s*&\s*a|q and a|questions?[\s-]*(?:and|&)[\s-]*answers?)(?:\s+(?:session|section))?|"
    r"(?:call |conference call |conference |company |corporate |other |event )*participants(?: list)?|contents|transcript)\s*:?\W*$",
    re.I,
)
LIST = re.compile(r"^\W*(?:[\w ]+ )?participants(?: list)?\s*:?\s*$", re.I)
CLOSING = re.compile(r"^\W*(?:duration\s*:?\s*\d+|end of (?:the )?(?:call|transcript|q&a)|call ended|more .{1,40} analysis|all earnings call transcripts|this (?:article|transcript) (?:is|was) )", re.I)
TITLE = re.compile(r"\b(?:officer|analyst|president|relations|director|chair(?:man|woman)?|treasurer|counsel|head|manager|ceo|cfo|coo|cto|operator|research|capital|securities|partners|bank|co|markets|host|moderator|founder|controller)\b", re.I)
OPERATORS = {"operator", "moderator", "coordinator", "conference operator", "call operator"}
HONORIFICS = {"dr", "mr", "mrs", "ms", "miss", "prof", "professor", "sir", "madam", "mx"}
# Sounds of hesitation, and words that name sounds or stage directions.
SOUNDS = r"(?:u+h+|u+m+|uhm+|e+r+m?|a+h+|h+m+|m+h*m+|mm+[-\s]?h+m+|mhm+|uh[-\s]?huh|huh|eh+|oh+)"
NOTE_WORDS = "instructions laughter laughs laughing laugh applause music inaudible indiscernible crosstalk cough coughs coughing pause silence phonetic chuckle chuckles sighs sigh noise technical difficulty audio gap foreign break ringing beep static".split()
NOTE = re.compile(rf"\(\([^()]*\)\)|\[[^\[\]]*\]|<[^<>]{{1,40}}>|\*[a-z ]{{2,30}}\*|\((?:[^()]{{0,30}}\b)?(?:{'|'.join(NOTE_WORDS)})\b[^()]{{0,30}}\)|[♪♫]+", re.I)
HESITATION = re.compile(rf"(?<![\w’'-]){SOUNDS}(?![\w’'-])(?:\s*[,—–]|\s*--|\.{{3}}|…)?", re.I)
FILLER = re.compile(r"(?<![\w’'-])(?:you know|i mean|like|sort of|kind of),\s*", re.I)
ANYTIME = re.compile(rf"[\[(]\s*{TIME}\s*[\])]|(?<![\w:$.,]){TIME}(?![\w:%])")


def _tokens(name: str) -> list[str]:
    got = [t.strip(".,").casefold() for t in name.split()]
    return [t for t in got if t and t not in HONORIFICS]


def _slip(a: str, b: str) -> bool:
    """One letter wrong, missing, extra, or two swapped, in words of five letters or more."""
    if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _same(a: str, b: str) -> bool:
    """Equal words but for a slip of the pen, a lost character standing for any one or more."""
    if "�" in a or "�" in b:
        x, y = (a, b) if "�" in a else (b, a)
        return re.fullmatch(re.sub("(?:�)+", ".{1,3}", re.escape(x)), y) is not None
    return a == b or _slip(a, b)


def _fits(short: list[str], full: list[str]) -> bool:
    """A label's words can stand for a full name: the surname, alone or after a given name or initials that agree."""
    if not short or not full or not _same(short[-1], full[-1]):
        return len(short) == 1 and len(full) > 1 and _same(short[0], full[0])
    given, whole = short[:-1], full[:-1]
    if not given or not whole:
        return True
    if not (_same(given[0], whole[0]) or (min(len(given[0]), len(whole[0])) == 1 and given[0][0] == whole[0][0])):
        return False
    return len(given) < 2 or len(whole) < 2 or given[1][0] == whole[1][0]


class Roster:
    """The speakers of one call: those listed, then those that labels add."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.words: list[list[str]] = []
        self.seen: list[int] = []
        self.listed = 0

    def add(self, name: str) -> None:
        name = " ".join(w for w in name.split() if w.strip(".,").casefold() not in HONORIFICS)
        words = _tokens(name)
        if words and words not in self.words:
            self.names.append(name)
            self.words.append(words)
            self.seen.append(1)
        elif words:
            i = self.words.index(words)
            self.seen[i] += 1
            if self.names[i].isupper() and not name.isupper() and i >= self.listed:
                self.names[i] = name

    def find(self, label: str) -> int | None:
        words = _tokens(label)
        if not words or len(words) > 6:
            return None
        fits = [i for i, w in enumerate(self.words) if _fits(words, w)]
        exact = [i for i in fits if self.words[i][-1] == words[-1]]
        closest = [i for i in exact if len(words) > 1 and self.words[i][0] == words[0]]
        return (closest or exact or fits or [None])[0]

    def join_forms(self) -> None:
        """Of the names that labels added, forms of one person become the fullest one."""
        kept = list(range(self.listed))
        order = sorted(range(self.listed, len(self.names)), key=lambda i: (-len(self.words[i]), self.names[i].isupper(), -self.seen[i], -sum(map(len, self.words[i])), i))
        for i in order:
            if not any(_fits(self.words[i], self.words[j]) for j in kept):
                kept.append(i)
        self.names, self.words = [self.names[i] for i in kept], [self.words[i] for i in kept]


def _namelike(name: str) -> bool:
    words = [w for w in name.split() if w.strip(".,").casefold() not in HONORIFICS]
    return 0 < len(words) <= 5 and all(w[0].isupper() and re.fullmatch(r"[^\W\d_][\w’'�-]*\.?", w) for w in words)


def _operator(label: str) -> bool:
    return " ".join(_tokens(label)) in OPERATORS


def _mentioned(label: str, text: str) -> bool:
    words = label.split()
    if len(words) > 1:
        return words[0].strip(".,").casefold() in HONORIFICS
    return re.search(rf"\b[^\W\d_][\w’'-]+(?: [A-Z]\.)? {re.escape(label)}\b(?!:)", text) is not None and label.casefold() not in ("guidance", "note", "outlook")


def label_of(line: str) -> tuple[str, str, bool] | None:
    """(name, speech after it, whether the form alone marks a label) if the line may start with a speaker's label."""
    m = re.match(r"^\[([^\[\]]{2,60})\]\s*[:—–-]*\s*(.*)$", line)
    if m:
        return (m[1], m[2], True) if _namelike(DASH.split(m[1])[0]) and not any(w in NOTE_WORDS for w in m[1].lower().split()) else None
    bare = PREFIX.sub("", line)
    strong = bare != line
    m = re.match(r"^([^:!?]{2,110}?)\s*:\s*(.*)$", bare)
    if m:
        head, speech = m[1], m[2]
        titled = re.match(r"^(.*?)\s*\(([^()]+)\)$", head)
        name = (titled[1] if titled else DASH.split(head)[0]).strip()
        if "," in name and TITLE.search(name.split(",", 1)[1]):
            name = name.split(",", 1)[0].strip()
        if _namelike(name):
            return name, speech, strong or bool(titled) or name != head.strip()
    if len(bare) <= 120:
        parts = DASH.split(re.sub(r"\s*(?:—|–|--+|-)\s*$", "", bare))
        titled = re.match(r"^(.*?)\s*\(([^()]+)\)$", bare)
        if titled and _namelike(titled[1]) and TITLE.search(titled[2]):
            return titled[1], "", True
        if _namelike(parts[0]) and (len(parts) > 1 and TITLE.search(parts[-1]) or _operator(parts[0])):
            return parts[0], "", True
        aside = bare.split(",", 1)
        if len(aside) > 1 and _namelike(aside[0]) and len(aside[0].split()) > 1 and len(bare) < 90 and TITLE.search(aside[1]) and not bare.endswith((".", "?", "!")):
            return aside[0], "", True
        if len(parts) == 1 and _namelike(bare):
            return bare, "", strong
    return None


def cleaned(text: str) -> str:
    """Speech without time marks, sound and stage notes and hesitation sounds, single-spaced."""
    text = NOTE.sub(" ", text)
    text = ANYTIME.sub(" ", text)
    text = HESITATION.sub(" ", text)
    text = FILLER.sub("", text)
    return re.sub(r"\s+([,.;:!?])", r"\1", " ".join(text.split()))


def spoken(text: str) -> bool:
    """Whether a word is left without marks, notes and hesitation sounds."""
    return re.search(r"[^\W_]", HESITATION.sub(" ", ANYTIME.sub(" ", NOTE.sub(" ", text)))) is not None


def seconds(mark: str) -> float:
    total = 0.0
    for part in mark.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def isotonic(values: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing series by least squares (pooling neighbours that stand in the wrong order)."""
    means, sizes = [], []
    for v in values:
        means.append(float(v))
        sizes.append(1)
        while len(means) > 1 and means[-2] > means[-1]:
            n = sizes[-2] + sizes[-1]
            means[-2:] = [(means[-2] * sizes[-2] + means[-1] * sizes[-1]) / n]
            sizes[-2:] = [n]
    return np.repeat(means, sizes)


def repaired_clock(times: list[float | None], drop: float = 90.0) -> list[float | None]:
    """Times that never run backwards: where the clock falls far and stays low it was reset, and a new segment starts there.

    Each segment continues from the end of the one before; inside a segment isotonic regression evens out marks in the
    wrong order. Missing times stay missing.
    """
    at = [i for i, t in enumerate(times) if t is not None]
    out: list[float | None] = [None] * len(times)
    segment: list[int] = []
    segments = []
    for k, i in enumerate(at):
        later = [times[j] for j in at[k : k + 3]]
        if segment and times[i] < times[segment[-1]] - drop and max(later) < times[segment[-1]]:
            segments.append(segment)
            segment = []
        segment.append(i)
    segments.append(segment)
    base = 0.0
    for own in segments:
        if own:
            fit = isotonic(np.array([times[i] for i in own])) + base
            for i, t in zip(own, fit, strict=True):
                out[i] = float(t)
            base = float(fit[-1])
    return out


def parse(text: str | None) -> list[tuple[int, str, str, float | None, float | None]]:
    """(turn_no, speaker, text, start, end in seconds or None) of one transcript whose characters are repaired.

    All time marks are repaired together. A stretch begins at the mark on or before its label, else where the marks before it end; it
    ends where the next one begins, the last one at its last mark. Stretches of one speaker that follow each other are one turn with one
    interval.
    """
    if not text:
        return []
    lines = [" ".join(x.split()) for x in re.split(r"\r\n|[\r\n\v\f\u0085  ]", text)]
    roster, body, in_list, entries = Roster(), [], False, 0
    for n, line in enumerate(lines):
        if in_list:
            entry = re.sub(r"^[*•◦·\-–]\s*", "", line)
            if entry and not HEADER.match(line) and not MARK.match(line) and (DASH.search(entry) or _namelike(entry) or _namelike(entry.split(",")[0])):
                name = re.sub(r"\s*\([^()]*\)$|,.*$", "", DASH.split(entry)[0])
                if not _operator(name):
                    roster.add(name)
                entries += 1
                continue
            if not line and not entries:
                continue
            in_list = False
        if LIST.match(line):
            in_list, entries = True, 0
        elif line and n and not HEADER.match(line) and not CLOSING.match(line):
            body.append(line)
        elif line and n == 0 and (MARK.match(line) or (label_of(line) or ("", "", False))[2]):
            body.append(line)
    roster.listed = len(roster.names)
    whole, marked = " ".join(body), []
    for line in body:
        m = MARK.match(line)
        rest = line[m.end() :] if m else line
        found = label_of(rest) if rest else None
        marked.append((seconds(m[1] or m[2]) if m else None, rest, found))
        if found and len(_tokens(found[0])) == 1 and roster.find(found[0]) is None and not _operator(found[0]) and ":" in rest and _mentioned(found[0], whole):
            # a surname alone is a label if the call names somebody so, or a title stands before it
            roster.add(found[0])
        elif found and not _operator(found[0]) and roster.find(found[0]) is None and len(_tokens(found[0])) > 1 and (found[2] or (found[1] or rest.endswith(":")) and not HEADER.match(found[0])):
            roster.add(found[0])
        elif found and len(_tokens(found[0])) > 1 and not _operator(found[0]) and (i := roster.find(found[0])) is not None and i >= roster.listed:
            roster.add(found[0])
    roster.join_forms()
    stretches: list[list] = []
    speaker, marks, waiting = None, [], []
    for at, rest, found in marked:
        if at is not None:
            waiting.append(len(marks))
            marks.append(at)
        if found:
            who = "Operator" if _operator(found[0]) else (roster.names[i] if (i := roster.find(found[0])) is not None else None)
            alone = len(_tokens(found[0])) == 1 and not found[1] and not found[2] and not rest.endswith(":")
            if who and not (alone and who != "Operator"):
                speaker, rest = who, found[1]
                # the mark next to the label is where the stretch begins; -1 before any mark
                stretches.append([who, [], waiting[-1] if waiting else None, len(marks) - 1])
                waiting = []
        if rest and speaker:
            stretches[-1][1].append(rest)
            stretches[-1][3] = len(marks) - 1
            waiting = []
    times = repaired_clock(marks)
    turns: list[list] = []
    for who, parts, first, last in stretches:
        raw = " ".join(parts)
        if not spoken(raw):
            continue
        begin = times[first] if first is not None else (turns[-1][3] if turns else None)
        end = times[last] if last >= 0 else None
        if turns and first is not None:
            # what was said before ends here
            turns[-1][3] = times[first]
        if turns and turns[-1][0] == who:
            turns[-1][1] += " " + cleaned(raw)
            turns[-1][3] = end
        else:
            turns.append([who, cleaned(raw), begin, end])
    return [(n, who, said.strip(), begin, end) for n, (who, said, begin, end) in enumerate(turns, 1)]


def speaker_turns(transcripts: DataFrame, id_col: str = "df_index", text_col: str = "transcript") -> DataFrame:
    """(id, turn_no, speaker, text, start_s, end_s): the turns of every transcript in order, characters repaired first.

    A turn is what one person says until another speaks; a label repeated for the same person starts no new one. A stretch of
    marks, notes and hesitation sounds only is no turn and doesn't part the speech around it. Speakers go by their name in
    the list of participants, else by the fullest form among their labels; whoever runs the call is ``Operator``. Clock
    times are repaired within the segments between resets. Null and blank texts, and texts without a label, give no row;
    repeated transcripts are read each. One transcript is one record of work, however long.
    """
    fixed = mojibake.repaired(transcripts, id_col, text_col)
    kind = dict(transcripts.dtypes)[id_col]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *turn) for i, text in zip(b["id"], b["text"], strict=True) for turn in parse(text)]
            frame = pd.DataFrame(rows, columns=["id", "turn_no", "speaker", "text", "start_s", "end_s"])
            yield frame.astype({"start_s": "float64", "end_s": "float64"})

    return fixed.select("id", "text").mapInPandas(read, f"id {kind}, turn_no int, speaker string, text string, start_s double, end_s double")
