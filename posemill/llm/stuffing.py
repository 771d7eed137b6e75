"""Keyword-stuffed pages and link lists: how regularly terms recur, and how much of a page is no sentence at all."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posemill.runtime import ship

ship(__name__)

# Function words of English, German and Spanish: what sentences have and lists of nouns lack.
FUNCTION_WORDS = frozenset(
    """
    a after again all although among an and another any are as at be because been before below between both but by can
    could did do does each every for from had has have he her here his how i if in into is it its many may might more
    most must no nobody none nor not of on once one only or our over please several she should since so some such than
    that the their them then there they this those through to under until up was we were what when where which while
    who whom whose why will with without would you your
    als am an auch auf aus bei beim bis da damit das dass davon dem den der des deshalb die diese dieser doch durch ein
    eine einem einen einer eines er es für gegen hat haben ich ihr ihre im in ist kein keine man mehr mit nach nicht noch
    nur ob oder ohne schon sein seine sich sie sind sobald so über um und uns unter vom von vor war waren weil wenn
    werden wie wir wird wurde wurden zu zum zur zwischen
    al aunque como con contra cuando de del desde donde durante el ella ellas ellos en entre era eran es esta estas este
    estos fue fueron hasta la las le lo los más menos mientras muy ni no nos o para pero por porque que qué se según ser
    si sin sobre son su sus también un una unas uno unos y ya
    """.split()
)
# Endings and marks by which a token is a link.
_LINK = re.compile(r"://|^www\.|^[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?:/\S*)?$")
_NUMBER = re.compile(r"^[-+]?\d+(?:[.,]\d+)?%?$|^[^\s=/]+=[-+]?\d+(?:\.\d+)?$")
_WORD = re.compile(r"[^\W_]+")
_ENDS = ".!?。！？…।"
_SENTENCE_END = re.compile(rf"(?<=[{_ENDS}])\s+")
# Scripts that put no blanks between words: each character is a word.
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_SEPARATOR = re.compile(r"[,;|>•·]|::|\s[/–-]\s")
_MARKS = ".,;:!?()[]{}\"'*#|<>/–-•·"

LIST_FUNCTION_SHARE = 0.15
LOW_FUNCTION_SHARE = 0.1
MEASURED_SHARE = 0.25
PIECES = 5
PIECE_WORDS = 4
RUN_LINES = 5
LAGS = 6
REGULAR_SHARE = 0.45
REGULAR_WORDS = 12
WIDE_LAGS = 30
WIDE_SHARE = 0.6
SENTENCE_WORDS = 25
PHRASE = 4
PHRASE_TIMES = 10
PHRASE_TURNS = 3
PHRASE_SHARE = 0.6
FORM_WORDS = 6
FORM_MARKS = 6
FORM_LETTERS = 3
FORM_DISTINCT = 0.9


def _parts(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, the sentence and line of each, and per line its text, separators and whether it ends like a sentence."""
    tokens: list[str] = []
    in_sentence: list[int] = []
    in_line: list[int] = []
    of_text, separators, closed = [], [], []
    sentence = -1
    for i, text in enumerate(texts):
        for line in (text or "").splitlines():
            if not line.isascii():
                line = _UNSPACED.sub(r" \g<0> ", line)
            if not (words := line.split()):
                continue
            parts = [words]
            if any(w[-1] in _ENDS for w in words[:-1]):
                parts = [p.split() for p in _SENTENCE_END.split(line.strip())]
            for p in parts:
                sentence += 1
                tokens += p
                in_sentence += [sentence] * len(p)
                in_line += [len(of_text)] * len(p)
            of_text.append(i)
            separators.append(len(_SEPARATOR.findall(line)))
            closed.append(words[-1][-1] in _ENDS)
    ints = lambda x: np.array(x, np.int64)
    return tokens, ints(in_sentence), ints(in_line), ints(of_text), ints(separators), np.array(closed, bool)


def _phrases(term: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which tokens stand in a phrase of PHRASE words that its text has at least PHRASE_TIMES times, mostly at equal distances.

    Distances of any length count, to the next occurrence or to one of the PHRASE_TURNS - 1 after it, as a period may hold a phrase more than once.
    """
    repeated = np.zeros(len(term), bool)
    n = len(term) - PHRASE + 1
    if n <= 2 * PHRASE_TURNS:
        return repeated
    code = doc[:n].astype(np.uint64)
    for i in range(PHRASE):
        code = (code ^ code >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + term[i : n + i].astype(np.uint64)
    code = (code ^ code >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    inside = np.flatnonzero(doc[:n] == doc[PHRASE - 1 :])
    if len(inside) <= 2 * PHRASE_TURNS:
        return repeated
    place = inside[np.argsort(code[inside], kind="stable")]
    begin = np.append(True, code[place[1:]] != code[place[:-1]])
    of = np.cumsum(begin) - 1
    times = np.bincount(of)
    even = np.zeros(len(place), bool)
    for turn in range(1, PHRASE_TURNS + 1):
        gap = place[turn:] - place[:-turn]
        alike = (of[2 * turn :] == of[: -2 * turn]) & (np.abs(gap[turn:] - gap[:-turn]) <= 1 + gap[turn:] // 10)
        for shift in (0, turn, 2 * turn):
            even[shift : shift + len(alike)] |= alike
    often = place[((times >= PHRASE_TIMES) & (np.bincount(of, even) >= PHRASE_SHARE * times))[of]]
    for i in range(PHRASE):
        repeated[often + i] = True
    return repeated


def _formed(tokens: list[str], seen: np.ndarray, codes: np.ndarray, core: list[str], term: np.ndarray, sentence: np.ndarray, real: np.ndarray, in_sentence: np.ndarray) -> np.ndarray:
    """Which sentences have the form of one in any language: a capital (or a letter without case) at the start, a full stop, question or
    exclamation mark at the end, at least FORM_WORDS words, at most one mark or separator in FORM_MARKS of them, and longer words
    that hardly repeat."""
    n = len(in_sentence)
    first = np.searchsorted(sentence, np.arange(n))
    last = np.searchsorted(sentence, np.arange(n), side="right") - 1
    opens = np.array([(c := t.lstrip("\"'([{¿¡«„“")[:1]).isalpha() and not c.islower() for t in seen])
    stops = np.array([t.rstrip("\"')]}»”")[-1:] in _ENDS and t[-1] != "," for t in seen])
    mark = np.array([t[-1] in ",;|>，；、" or not _WORD.search(t) for t in seen])[codes]
    long = np.array([len(c) > FORM_LETTERS for c in core])[codes] & real
    pairs = np.unique(sentence[long] * (int(term.max()) + 1) + term[long]) // (int(term.max()) + 1)
    distinct = np.bincount(pairs, minlength=n) >= FORM_DISTINCT * np.bincount(sentence, long, n)
    few = FORM_MARKS * np.bincount(sentence, mark, n) <= in_sentence + FORM_MARKS
    return opens[codes[first]] & stops[codes[last]] & (in_sentence >= FORM_WORDS) & few & distinct


def list_shares(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of every text, and how many of them stand in lists or regular repetition instead of sentences.

    Works on all texts of a batch at once. A token's terms recur regularly where, within a line, most content words meet
    themselves again inside the lag window (the autocorrelation of the token sequence at lags 1 to LAGS, or to WIDE_LAGS where a
    line runs on without the ends of sentences; adjacent lines too short to show it are taken together), or where most of them stand in
    phrases that the whole text repeats at equal distances, however long; a sentence is a list of nouns where hardly any function word occurs
    and it has not the form of a sentence either (_formed, which needs no word list, so that prose of any language is none); a line is a list where many separators part short pieces; short
    unclosed lines are a list where several follow one another. Parts in which every fourth token is a
    number are measured values, never lists.
    """
    tokens, sentence, line, of_text, separators, closed = _parts(texts)
    if not tokens:
        return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    codes, seen = pd.factorize(np.array(tokens, object))
    core = [t.strip(_MARKS).lower() for t in seen]
    term = pd.factorize(np.array(core, object))[0][codes]
    link = np.array([bool(_LINK.search(t)) for t in core])
    words = np.array([len(_WORD.findall(t)) for t in seen])[codes]
    function = np.array([t in FUNCTION_WORDS for t in core])[codes]
    number = (np.array([bool(_NUMBER.match(t)) for t in core]) & ~link)[codes]
    real = words > 0
    content = real & ~function & ~number
    n_sentences, n_lines = int(sentence[-1]) + 1, len(of_text)

    def per(key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(key, weight, n)

    in_sentence, in_line = per(sentence, real, n_sentences), per(line, real, n_lines)
    linking = per(sentence, function, n_sentences)
    bare = (linking < LIST_FUNCTION_SHARE * in_sentence) & ((linking < 2) | (linking < LOW_FUNCTION_SHARE * in_sentence))
    bare &= per(sentence, number, n_sentences) < MEASURED_SHARE * in_sentence
    bare &= ~_formed(tokens, seen, codes, core, term, sentence, real, in_sentence)
    free = per(line, number, n_lines) < MEASURED_SHARE * in_line
    parted = (separators >= PIECES) & (in_line <= PIECE_WORDS * (separators + 1)) & free
    short = (in_line <= PIECE_WORDS) & ~closed & free
    begins = np.ones(n_lines, bool)
    begins[1:] = (of_text[1:] != of_text[:-1]) | (short[1:] != short[:-1])
    run = np.cumsum(begins) - 1
    runs = short & (np.bincount(run)[run] >= RUN_LINES)
    recurs = np.zeros(len(term), bool)
    of_content = per(line, content, n_lines)
    # adjacent lines too short to show a recurrence are one stretch, which measured values end
    brief = (in_line < REGULAR_WORDS) & free
    apart = np.ones(n_lines, bool)
    apart[1:] = (of_text[1:] != of_text[:-1]) | ~brief[1:] | ~brief[:-1]
    stretch_of = np.cumsum(apart) - 1
    stretch = stretch_of[line]
    n_stretches = int(stretch[-1]) + 1
    across = np.zeros(len(term), bool)
    for lag in range(1, WIDE_LAGS + 1):
        same = (term[lag:] == term[:-lag]) & (line[lag:] == line[:-lag])
        recurs[lag:] |= same
        recurs[:-lag] |= same
        if lag <= LAGS:
            same = (term[lag:] == term[:-lag]) & (stretch[lag:] == stretch[:-lag])
            across[lag:] |= same
            across[:-lag] |= same
        if lag == LAGS:
            in_stretch = per(stretch, real, n_stretches)
            regular = (per(stretch, across & content, n_stretches) >= REGULAR_SHARE * per(stretch, content, n_stretches)) & (in_stretch >= REGULAR_WORDS)
            regular = regular[stretch_of] & free
    ends = np.array([t[-1] in _ENDS for t in seen])[codes]
    endless = (in_line >= SENTENCE_WORDS) & (in_line >= SENTENCE_WORDS * per(line, ends, n_lines))
    wide = (per(line, recurs & content, n_lines) >= WIDE_SHARE * of_content) & endless & free
    repeated = per(sentence, _phrases(term, of_text[line]) & content, n_sentences)
    contents = per(sentence, content, n_sentences)
    again = (repeated >= PHRASE_SHARE * contents) & (contents > 0) & (per(sentence, number, n_sentences) < MEASURED_SHARE * in_sentence)
    flagged = (bare | again)[sentence] | (parted | runs | regular | wide)[line]
    doc = of_text[line]
    return np.bincount(doc, words, len(texts)).astype(np.int64), np.bincount(doc, words * flagged, len(texts)).astype(np.int64)


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        total, listed = list_shares(b["text"].tolist())
        yield pd.DataFrame({"id": b["id"], "n_words": total, "n_listed": listed})


def list_pages(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_words, n_listed, share for every document; a page is spam where share > 1/2.

    One pass over the texts without a shuffle; the texts of an Arrow batch are measured together as numpy arrays, so the
    cost is linear in characters, also for very long texts. Words are runs of letters and digits, or single characters in scripts without blanks.

    Defined cases: null, blank and wordless texts have n_words = 0 and share 0; null ids are kept; repeated texts each
    give a row; an empty table gives no rows. Other columns are ignored.
    """
    rows = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    measured = rows.mapInPandas(_measure, f"id {dict(rows.dtypes)['id']}, n_words long, n_listed long")
    share = F.coalesce(F.try_divide(F.col("n_listed"), F.col("n_words")), F.lit(0.0))
    return measured.select(F.col("id").alias(doc_id), "n_words", "n_listed", share.alias("share"))
