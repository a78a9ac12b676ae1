"""Sentence boundaries across languages and scripts (problem 1).

The rules are a finite transducer. A lexer turns text into signs (sentence
marks, verse ends, quotation marks, line ends; numbers, abbreviations and
ellipses inside sentences are read over), and the transducer's state is which
quotation is open, whether it last held a sentence mark, and what could still
take the last boundary back. It writes ``cut`` at a boundary and ``undo`` where
a later sign shows the last cut to be none: a half verse before its double
danda, a question before the words that ask it.

A text of more than two pieces (of about ``piece`` characters) is parted between
words and its pieces go to different tasks. Each is run from every state it can
begin in, which gives its state-transition function; a parallel prefix scan
(doubling, one join a round) composes the functions of a text, so that each piece
learns the state it begins in and is run once more from it. A cut and its undo may
lie in different pieces: they meet in a window. The result is that of one run over
the whole text, whatever ``piece`` is.

Defined results: null and empty texts and texts of blanks only have no units;
an unclosed quotation ends with its line's sentence or the text; repeated keys
count once per distinct text; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PIECE = 1000
# Abbreviations that never end a sentence, those that may, words that carry on after a quotation, verbs that ask it.
NEVER_LAST = "Mr Mrs Ms Dr Prof Shri Smt Sri St Rev No Nos cf ch chs pp p vol vols ed eds viz fig i.e e.g vs प्रा डॉ कै सौ न्या श्री श्रीमती पं ह.भ.प इ.स ई.स उदा पृ भा खं क्र सं स्व चि ಡಾ ಶ್ರೀ ಕ್ರಿ.ಶ ಪು ಸಂ".split()
MAY_BE_LAST = "a.m p.m Co Ltd Inc etc".split()
CARRYING_ON = re.compile(r"(?:असे|असं|असा|अशी)\s(?!कसे)|ಎಂದ|と|って")
ASKING = ("पूछा", "कहा", "बोले", "बोला", "पूछी")
FINAL_SYLLABLES = "है हैं था थी थे थीं हो ना दो लो जा हूँ नहीं".split()
CLOSER_OF = {"“": "”", "‘": "’", '"': '"', "「": "」", "『": "』"}

_D = "0-9०-९೦-೯๐-๙"
_LEX = re.compile(
    rf"(?P<verse>(?:॥|।[  ]?।|\|\|)(?:[  ]*[{_D}]+[  ]*(?:॥|।[  ]?।|\|\|))?)"
    rf"|(?P<num>[{_D}]+(?:[.,:][{_D}]+)+)"
    rf"|(?P<may>(?<!\w)(?:{'|'.join(map(re.escape, MAY_BE_LAST))})\.)"
    rf"|(?P<abbr>(?<![\wऀ-ൿ])(?:{'|'.join(map(re.escape, sorted(NEVER_LAST, key=len, reverse=True)))}|[A-Z]|(?!(?:{'|'.join(FINAL_SYLLABLES)})\.)[अ-ह]?[ा-ौ]?ं?(?<=[ऀ-ॿ])|[ಅ-ಹ][ಾ-ೌ]?)\.)"
    r"|(?P<mid>(?<=\s)(?:\.{2,}|…)(?=\s))"
    r"|(?P<term>[.!?…।。！？｡]+|(?<=[ऀ-ॿ] )\|(?!\|)|(?<=[ऀ-ॿ])\|(?!\|))"
    r"|(?P<quote>[“”‘\"「」『』]|’(?!\w)|(?<!\w)’)"
    r"|(?P<line>\n+)"
    r"|(?P<thai>(?<=[฀-๿]) +(?=[฀-๿]))"
)
_BLANK = re.compile(r"\s*")
_LAST = re.compile(r"([ऀ-ॿ]+)\s*$")

# A state: open quotation, sentence mark last in it, quotation opened its unit, what can be taken back ('' none, 'v' half verse, 'q' quotation), text since the last boundary.
State = tuple[str, bool, bool, str, bool]
START: State = ("", False, False, "", False)


@cache
def states() -> tuple[State, ...]:
    """All states in which a piece can begin, in fixed order: the domain of its function.

    Pieces begin after a letter, so there is text since the last boundary; without
    an open quotation nothing of one is kept.
    """
    none = [("", False, False, u, True) for u in ("", "v", "q")]
    return tuple(none + [(q, t, s, u, True) for q in CLOSER_OF for t in (False, True) for s in (False, True) for u in ("", "v", "q")])


def settled(state: State) -> State:
    """A state as one in which a piece can begin."""
    quote, ended, first, undo, _ = state
    return (quote, ended, first, undo, True) if quote else ("", False, False, undo, True)


def run(text: str, begin: int, end: int, state: State) -> tuple[State, list[tuple[int, bool]]]:
    """State after text[begin:end] and what is written: (position, True) a cut, (position, False) an undo."""
    quote, ended, first, undo, body = state
    out: list[tuple[int, bool]] = []
    at = begin
    marked = -1  # end of the last sentence mark, for closing marks that touch it
    for m in _LEX.finditer(text, begin, end):
        kind, s, e = m.lastgroup, m.start(), m.end()
        if s > at and not body:
            body = bool(text[at:s].strip())
        if kind in ("num", "abbr", "mid"):
            at, body = e, True
            continue
        if kind == "quote":
            sign = m.group()
            if quote:
                if sign == CLOSER_OF[quote]:
                    quote = ""
                    if ended:
                        word = _follows(text, e)
                        if not word or not _carries_on(word):
                            out.append((e, True))
                            undo, body = ("q" if first and word and "ऀ" <= word[0] <= "ॿ" else ""), False
                        marked = e
                    ended = False
                else:
                    ended = False
            elif sign in CLOSER_OF and not (sign == '"' and s == marked):
                quote, ended, first = sign, False, not body
                body = True
            elif s == marked:  # closes what began before the text
                if out and out[-1] == (s, True):
                    out[-1] = (e, True)
                elif out or s == begin:
                    out += [(s, False), (e, True)]
                marked = e
            at = e
            continue
        if kind == "line":
            if quote and ended:
                out.append((_rstrip(text, begin, s), True))
                quote, ended, undo, body = "", False, "", False
            at = e
            continue
        if kind == "thai":
            if not quote:
                out.append((s, True))
                undo, body = "", False
            at = e
            continue
        # A sentence mark.
        sign = m.group()
        after = text[e : e + 1]
        if kind == "may":
            word = _follows(text, e)
            if word and (word[0].islower() or word[0] in ",;)" or word[0].isdigit()):
                at, body = e, True
                continue
        elif kind == "term":
            if sign == "." and after and (after.isalnum() or after in ",;)"):
                at, body = e, True
                continue
            if sign[0] in ".…" and len(sign) + (sign[0] == "…") >= 2:
                word = _follows(text, e)
                if word and word[0].islower() and after.isspace():
                    at, body = e, True
                    continue
        at = e
        if quote:
            ended = True
            continue
        if kind == "verse":
            if undo == "v" and body:
                out.append((s, False))
            elif not body and out == [] and undo == "v":
                out.append((s, False))
            out.append((e, True))
            undo, body, marked = "", False, e
            continue
        if not body and s > begin and undo != "q":
            # A mark that stands alone goes with what is before it.
            if out and out[-1][1] and not text[out[-1][0] : s].strip():
                out[-1] = (e, True)
                marked = e
                continue
        if undo == "q" and (w := _LAST.search(text, max(begin, s - 24), s)) and w.group(1) in ASKING:
            out.append((s, False))
        out.append((e, True))
        undo, body, marked = ("v" if sign in ("।", "|") else ""), False, e
    if at < end and not body:
        body = bool(text[at:end].strip())
    return (quote, ended, first, undo, body), out


def _follows(text: str, at: int) -> str:
    begin = _BLANK.match(text, at).end()
    return text[begin : begin + 12]


def _carries_on(word: str) -> bool:
    return word[0].islower() or word[0] in ",;—–-" or bool(CARRYING_ON.match(word))


def _rstrip(text: str, begin: int, at: int) -> int:
    while at > begin and text[at - 1].isspace():
        at -= 1
    return at


def kept(written: list[tuple[int, bool]], text: str) -> list[int]:
    """Ends of the units of a whole text: cuts that aren't taken back, and the end of what follows the last."""
    ends: list[int] = []
    for at, is_cut in written:
        if is_cut:
            if not ends or text[ends[-1] : at].strip():
                ends.append(at)
            else:
                ends[-1] = at
        elif ends:
            ends.pop()
    last = _rstrip(text, 0, len(text))
    if last > (ends[-1] if ends else 0):
        ends.append(last)
    return ends


def unit_ends(text: str | None) -> list[int]:
    """Ends of the sentence units of one text."""
    return kept(run(text, 0, len(text), START)[1], text) if text else []


_BETWEEN = re.compile(r"(?<=[^\W\d_฀-๿]{2}) (?=[^\W\d_฀-๿]{2})|(?<=[฀-๿]{3})(?=[฀-๿]{3})|(?<=[぀-ヿ一-鿿]{3})(?=[぀-ヿ一-鿿]{3})")


def _parts(text: str, piece: int) -> list[tuple[int, int]]:
    """Pieces that begin after a blank between letters, or between letters of a script without blanks."""
    cuts, at = [0], piece
    while at < len(text):
        m = _BETWEEN.search(text, at)
        if not m:
            break
        cuts.append(m.end())
        at = m.end() + piece
    return list(zip(cuts, [*cuts[1:], len(text)]))


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [unit_ends(t) for t in batch.column("text").to_pylist()]
        at = [i for i, e in enumerate(ends) for _ in e]
        if at:
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(rows), pa.array([k + 1 for e in ends for k in range(len(e))], pa.int32()), pa.array([s for e in ends for s in [0, *e][: len(e)]], pa.int32()), pa.array([x for e in ends for x in e], pa.int32())],
                names=["key", "unit_no", "after", "end_char"],
            )


def _cut_up(piece: int):
    """key, seq, b, e, text, marks: the pieces of a text with some of what follows, and the quotation marks that open one anywhere in it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                marks = "".join(q for q in CLOSER_OF if q in text)
                rows += [(key, seq, b, e, text[b : e + 64], marks) for seq, (b, e) in enumerate(_parts(text, piece))]
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "seq", "b", "e", "text", "marks"])

    return go


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their state-transition functions; states that can't occur in the text lead to the first."""
    every = states()
    index = {s: i for i, s in enumerate(every)}
    for batch in batches:
        fs = []
        for seq, b, e, text, marks in zip(*(batch.column(c).to_pylist() for c in ("seq", "b", "e", "text", "marks"))):
            if seq == 0:
                end = index[settled(run(text, 0, e - b, START)[0])]
                fs.append([end] * len(every))
            else:
                fs.append([index[settled(run(text, 0, e - b, s)[0])] if not s[0] or s[0] in marks else 0 for s in every])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "seq", "b", "e", "text")), pa.array(fs, pa.list_(pa.int32()))], names=["key", "seq", "b", "e", "text", "f"])


def _pieces_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each piece writes from the state it begins in; joins marks a cut with only blanks since the one before."""
    for batch in batches:
        rows = []
        for key, seq, b, e, text, begin in zip(*(batch.column(c).to_pylist() for c in ("key", "seq", "b", "e", "text", "begin"))):
            written = run(text, 0, e - b, START if begin is None else states()[begin])[1]
            for k, (at, is_cut) in enumerate(written):
                joins = is_cut and k > 0 and written[k - 1][1] and not text[written[k - 1][0] : at].strip()
                rows.append((key, seq, k, at + b, is_cut, joins))
        if rows:
            cols = list(zip(*rows))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "seq", "k", "at", "is_cut", "joins"])


def scan(functions: DataFrame, rounds: int) -> DataFrame:
    """key, seq, f: the composition of all functions up to each piece, by doubling."""
    done = functions.select("key", "seq", "f")
    for k in range(rounds):
        before = done.select("key", (F.col("seq") + (1 << k)).alias("seq"), F.col("f").alias("g"))
        done = done.join(before, ["key", "seq"], "left").select("key", "seq", F.when(F.col("g").isNull(), F.col("f")).otherwise(F.transform("g", lambda s: F.get("f", s))).alias("f"))
    return done


def sentences(df: DataFrame, key: str, text: str, piece: int = PIECE) -> DataFrame:
    """key, unit_no, after, end_char: one row per sentence unit; it lies between ``after`` and ``end_char``, blanks first.

    Texts of up to two pieces are one; the pieces of longer ones are spread over
    the tasks before they are run.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    short = rows.where(F.length("text") <= 2 * piece).mapInArrow(_short, "key string, unit_no int, after int, end_char int").distinct()
    return short.unionByName(_long(rows.where(F.length("text") > 2 * piece), piece))


def _long(rows: DataFrame, piece: int) -> DataFrame:
    from pothi.plans.lineage import cut

    # A key may stand with several texts: each is scanned for itself.
    named = rows.select("key", F.xxhash64("text").cast("string").alias("h"), "text").select(F.concat_ws("\u0001", "h", "key").alias("key"), "text")
    pieces = named.mapInArrow(_cut_up(piece), "key string, seq int, b bigint, e bigint, text string, marks string")
    once = pieces.dropDuplicates(["key", "seq"])  # an exchange by key and number: the pieces of a text go apart
    functions = cut(once.mapInArrow(_functions, "key string, seq int, b bigint, e bigint, text string, f array<int>"))
    most = functions.agg(F.max("seq")).first()[0] or 0
    upto = scan(functions, max(1, most.bit_length()))
    begin = upto.select("key", (F.col("seq") + 1).alias("seq"), F.get("f", F.lit(0)).alias("begin"))
    runs = functions.select("key", "seq", "b", "e", "text").join(begin, ["key", "seq"], "left")
    written = runs.mapInArrow(_pieces_run, "key string, seq int, k int, at bigint, is_cut boolean, joins boolean")
    w = W.partitionBy("key").orderBy("seq", "k")
    # A cut goes when it is taken back, or when only blanks part it from the next.
    gone = F.coalesce(~F.lead("is_cut").over(w) | F.lead("joins").over(w), F.lit(False))
    cuts = written.withColumn("gone", gone).where("is_cut AND NOT gone").select("key", "at")
    # The last piece ends where the text does.
    tail = functions.groupBy("key").agg(F.max_by(F.struct("b", F.substring("text", F.lit(1), (F.col("e") - F.col("b")).cast("int")).alias("t")), "seq").alias("r"))
    last = tail.select("key", (F.col("r.b") + F.length(F.regexp_replace("r.t", r"(?U)\s+$", ""))).alias("at")).where("at > 0")
    ends = cuts.unionByName(last).distinct()
    w = W.partitionBy("key").orderBy("at")
    units = ends.select(F.substring_index("key", "\u0001", -1).alias("key"), F.row_number().over(w).alias("unit_no"), F.coalesce(F.lag("at").over(w), F.lit(0)).cast("int").alias("after"), F.col("at").cast("int").alias("end_char"))
    return units.distinct()
