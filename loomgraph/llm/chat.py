"""Transcript parsing by a hidden Markov model, and canonical rendering of turns.

Each line of a transcript shows a speaker marker (a name before a colon, a
bracketed or hashed role; plain, misspelt or quoted), and line features: a
question mark at the end, list or code look, length, the case of its first
letter, whom it addresses, whether a blank line came before.  States are a role
and the line's place in its turn: the first, the second, the third or a later
one.  What the first three lines show and how often a turn ends there is learned
by role; later lines are alike for all roles, so that a long turn isn't cut for
its length.  Markers are evidence like the other features.  Counts come from a
bounded number of labelled transcripts, whatever their length, with smoothing;
Viterbi recovers the states, and runs of one turn become canonical turns.

A transcript is decoded and rendered as a whole, whatever its length.  All lines
are sorted and dealt out in pieces of at most BLOCK lines, one row each, so the
lines of a long transcript are read and told apart by many tasks.  Two steps run
along a transcript: Viterbi over two bytes a line, which keeps twelve bytes of back
pointers a line, and the hash of the rendered text, which holds a turn at a time.
Scores are whole numbers, so no result depends on where pieces end.

Defined results: null lines count as empty, empty transcripts have no turns, an
unmarked line is decided by its features alone.  Repeated rows give repeated
lines, in the order of turn, role and text.  Lines that look like the canonical
form's own marks are rendered with a backslash before them.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Memo, cut, ensure_importable, partition_operator, rows_operator, shared_dir

ROLES = ("system", "user", "assistant")
#: Lines of a turn that are told apart: its first ones, and all later ones.
DEPTH = 4
STATES = [(r, d) for r in ROLES for d in range(DEPTH)]
#: Lines of a piece (a power of two), and labelled transcripts that training takes at most.
BLOCK, MAX_TRAIN = 2048, 2_000
#: Lines that each state of every model has seen marked or not marked, and share of features that are as in any state.
PRIOR, ODD = 300, 0.1

# Names that commonly mark speakers, by role.
NAMES = {
    "system": "system", "sys": "system", "instructions": "system",
    "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "client": "user", "me": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant", "answer": "assistant", "a": "assistant", "model": "assistant",
}
# Words that address a reader, and that name a speaker.
SECOND = frozenset("you your yours du dein deine sie ihr ihre vous votre vos toi tu usted su tus".split())
SPEAKER = frozenset("i my me we our ich mein meine wir je mon ma mes nous yo mi nosotros".split())
MARKER = re.compile(r"^\s*([#>*\-\[<|(]*)\s*([A-Za-z]{1,12})\s*(?:[\])>|*]*\s*:|[\])>|]+)\s*", re.A)
#: Lines that could be taken for marks of the canonical form.
MARK = re.compile(r"^\\*<\|", re.M)


def _misspelt(name: str) -> set[str]:
    """A name with two letters swapped, one left out or one doubled."""
    return {name[:i] + x + name[i + 2 :] for i in range(len(name) - 1) for x in (name[i + 1] + name[i], name[i])} | {name[:i] + name[i : i + 1] + name[i:] for i in range(len(name))}


FUZZY = {x: role for name, role in NAMES.items() if len(name) > 3 for x in _misspelt(name) if x not in NAMES}


def marker(line: str) -> tuple[str, str, int]:
    """The role that a line's speaker marker names ('' for none), its kind (plain, fuzzy or quoted) and the marker's length."""
    m = MARKER.match(line)
    if not m:
        return "", "", 0
    word = m[2].lower()
    role = NAMES.get(word) or FUZZY.get(word, "")
    if not role:
        return "", "", 0
    return role, "quoted" if m[1] == ">" else "plain" if word in NAMES else "fuzzy", m.end()


#: What a line shows by itself: a marker's role and kind, its look, its length class, the case of its first letter, whom it addresses.
MARKS = ["", *(f"{kind} {role}" for kind in ("plain", "fuzzy", "quoted") for role in ROLES)]
LENGTHS = 16
SHOWN = [(mark, look, length, case, who) for mark in MARKS for look in ("", "?", "`") for length in range(LENGTHS) for case in "0a" for who in ("", "you", "i")]
NUMBERS = {x: i for i, x in enumerate(SHOWN)}
#: Its place: the first line, after a line that is not blank, after a blank one.
PLACES = ("first", "next", "after")


def shown(line: str | None) -> int:
    """The number in SHOWN of what a line shows; 0 for blank lines only."""
    line = line or ""
    role, kind, n = marker(line)
    rest = line[n:].strip()
    # three classes for each doubling from 16 characters on
    length = max(1, min(LENGTHS - 1, int(3 * math.log2(len(rest) + 1)) - 11)) if rest else 0
    look = "?" if rest.endswith("?") else "`" if rest.startswith(("```", "- ", "* ", "1.")) else ""
    words = set(rest[:400].lower().split())
    who = "you" if words & SECOND else "i" if words & SPEAKER else ""
    return NUMBERS[f"{kind} {role}" if role else "", look, length, "a" if rest[:1].islower() else "0", who]


def placed(seen: Iterable[int], before: int | None = None) -> Iterator[tuple[int, int]]:
    """What lines show, with their places; before is what the line before them shows, if there is one."""
    for x in seen:
        yield x, 0 if before is None else 2 if before == 0 else 1
        before = x


def counted(states: list[int], seen: Iterable[int], before: tuple[int, int] | None = None) -> Counter:
    """Numbers of (e, state, what it shows, place), (m, state, next state) and (s, first state) in successive lines; before: state and looks of the line before them."""
    out: Counter = Counter(("e", s, x, at) for s, (x, at) in zip(states, placed(seen, before and before[1])))
    out.update(("m", a, b, 0) for a, b in zip([before[0], *states] if before else states, states if before else states[1:]))
    if states and before is None:
        out["s", states[0], 0, 0] += 1
    return out


@dataclass
class Model:
    """Counts of symbols by state, of moves between states and of first states."""

    emit: list[Counter] = field(default_factory=lambda: [Counter() for _ in STATES])
    move: np.ndarray = field(default_factory=lambda: np.ones((len(STATES), len(STATES))))
    start: np.ndarray = field(default_factory=lambda: np.ones(len(STATES)))

    def learn(self, counts: dict[tuple[str, int, int, int], int]) -> Model:
        for (what, a, b, at), n in counts.items():
            if what == "e":
                for part in self._parts(b, at):
                    self.emit[a][part] += n
            elif what == "m":
                self.move[a, b] += n
            else:
                self.start[a] += n
        return self

    #: Numbers of different values of the parts of a symbol.
    SIZES = (3 * len(MARKS), 3, LENGTHS, 2, 3)

    @staticmethod
    def _parts(x: int, at: int) -> list[str]:
        """The independent parts of a symbol; how a line is marked and where it stands tell together whether a turn begins."""
        mark, look, length, case, who = SHOWN[x]
        return [f"{mark}|{PLACES[at]}", f"l{look}", f"n{length}", f"c{case}", f"w{who}"]

    def prepare(self) -> Model:
        """Scores from the counts.  How long later lines go on and what they show are shared by the roles."""
        depth = np.array([d for _, d in STATES])
        begins = depth == 0
        role = np.array([ROLES.index(r) for r, _ in STATES])
        goes_on = (role[:, None] == role) & (depth == np.minimum(depth[:, None] + 1, DEPTH - 1))
        # a turn ends or goes on: by role in its first lines, for all roles together later
        on, ends = np.where(goes_on, self.move, 0).sum(axis=1), np.where(begins, self.move, 0).sum(axis=1)
        later = depth == DEPTH - 1
        on[later], ends[later] = on[later].sum(), ends[later].sum()
        stay = (on / (on + ends))[:, None]
        # who speaks next depends on who spoke
        follows = np.stack([np.where(begins, self.move, 0)[role == r].sum(axis=0) for r in range(len(ROLES))])[role]
        with np.errstate(divide="ignore"):
            logs = np.log(np.where(goes_on, stay, (1 - stay) * follows / follows.sum(axis=1, keepdims=True)))
        self.log_move = np.where(goes_on | begins, self._whole(np.maximum(logs, -1e3)), -(1 << 50))
        self.log_start = np.where(begins, self._whole(np.log(self.start / self.start.sum())), -(1 << 50))
        shared = sum((self.emit[i] for i in np.flatnonzero(later)), Counter())
        self.shared = [shared if later[i] else self.emit[i] for i in range(len(STATES))]
        self.cache: dict[tuple[int, int], np.ndarray] = {}
        self.steps = Memo(self._step, 8 << 20)
        return self

    @staticmethod
    def _whole(logs: np.ndarray) -> np.ndarray:
        """Scores as whole numbers: their sums are exact in any order."""
        return np.rint(logs * (1 << 20)).astype(np.int64)

    def _emission(self, x: int, at: int) -> np.ndarray:
        if (x, at) not in self.cache:
            total = np.zeros(len(STATES))
            mark = SHOWN[x][0]
            pool = sum(self.emit, Counter())
            lines = sum(pool.values()) / len(self.SIZES)
            for s, (role, depth) in enumerate(STATES):
                # every state has seen PRIOR lines at the three places: those that begin a turn with its plain marker, the others without one
                usual = f"plain {role}" if depth == 0 else ""
                n = sum(self.shared[s].values()) / len(self.SIZES)
                for i, (part, size) in enumerate(zip(self._parts(x, at), self.SIZES)):
                    prior = 0 if i else PRIOR
                    own = (self.shared[s][part] + (prior / len(PLACES) if mark == usual else 0) + 0.5) / (n + size / 2 + prior)
                    total[s] += np.log(own if i == 0 else (1 - ODD) * own + ODD * (pool[part] + 0.5) / (lines + size / 2))
            self.cache[x, at] = self._whole(total)
        return self.cache[x, at]

    def _step(self, given: tuple[bytes, int, int]) -> tuple[bytes, bytes]:
        """From scores of the states and what the next line shows: the next scores, the best one 0, and the back pointers."""
        before, x, at = given
        reach = np.frombuffer(before, np.int64)[:, None] + self.log_move
        v = reach.max(axis=0) + self._emission(x, at)
        return (v - v.max()).tobytes(), reach.argmax(axis=0).astype(np.uint8).tobytes()

    def path(self, seen: Iterable[int]) -> bytes:
        """The most likely states of a whole transcript, from the numbers of what its lines show."""
        v, back = b"", bytearray()
        for x, place in placed(seen):
            if v:
                v, step = self.steps[v, x, place]
                back += step
            else:
                v = (self.log_start + self._emission(x, place)).tobytes()
        if not v:
            return b""
        at, n = int(np.frombuffer(v, np.int64).argmax()), len(STATES)
        out = bytearray([at])
        for i in range(len(back) - n, -1, -n):
            at = back[i + at]
            out.append(at)
        return bytes(out[::-1])

    def decode(self, lines: list[str]) -> list[int]:
        """The most likely states of the lines of a transcript."""
        return list(self.path(map(shown, lines)))


def text_of(line: str, role: str) -> str:
    """The first line of a turn without its marker, if that names the turn's role and isn't quoted."""
    named, kind, n = marker(line)
    return line[n:] if named == role and kind != "quoted" else line


def turns(lines: list[str], states: list[int]) -> list[tuple[str, str]]:
    """(role, text) of the turns that states make of lines; markers are taken off."""
    out: list[list] = []
    for line, s in zip(lines, states):
        role, depth = STATES[s]
        if depth == 0 or not out:
            out.append([role, [text_of(line, role)]])
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(parts).strip()) for role, parts in out]


def render(found: list[tuple[str, str]]) -> str:
    """The canonical form: a role header and the text of each turn; what looks like a mark in a text is escaped."""
    return "".join(f"<|{role}|>\n{MARK.sub(chr(92) * 2 + chr(92) + 'g<0>', text)}\n<|end|>\n" for role, text in found)


def from_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", blanks: bool = True) -> DataFrame:
    """Raw transcript lines of a table of turns: conv, line number (by turn), line, state.

    Transcripts are as ragged as raw ones, by a hash of the conversation and the
    turn: the marker's style is the conversation's or, for one turn in four,
    another one; one turn in six goes unmarked, whoever speaks, and one in twelve
    is misspelt; one in ten quotes a marked line of another speaker.  With blanks,
    one line in eight within texts and every other turn is followed by a blank
    line.  state is the number of the line's true state, for training and measuring.
    """
    name = F.coalesce(F.col(role), F.lit("user"))
    draw = lambda what, n: F.pmod(F.xxhash64(F.col(conv), F.col(turn), F.lit(what)), F.lit(n))
    style = F.when(draw("other", 4) == 0, draw("style", 3)).otherwise(F.pmod(F.xxhash64(conv), F.lit(3)))
    spelt = F.when(draw("misspelt", 12) == 0, F.concat(F.substring(name, 1, 2), F.substring(name, 4, 1), F.substring(name, 3, 1), F.substring(name, 5, 99))).otherwise(name)
    marked = F.when(style == 0, F.concat(F.initcap(spelt), F.lit(": "))).when(style == 1, F.concat(F.lit("["), spelt, F.lit("] "))).otherwise(F.concat(F.lit("### "), F.initcap(spelt), F.lit(": ")))
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(F.concat(F.when(draw("unmarked", 6) == 0, F.lit("")).otherwise(marked), body), "\n")
    quoted = F.concat(F.when(name == "user", F.lit("> Assistant: ")).otherwise(F.lit("> User: ")), F.substring(F.split_part(body, F.lit("\n"), F.lit(1)), 1, 60))
    lines = F.when(draw("quoted", 10) == 0, F.concat(lines, F.array(quoted))).otherwise(lines)
    if blanks:
        blank = lambda x, i: F.when(F.pmod(F.xxhash64(F.col(conv), F.col(turn), i), F.lit(8)) == 0, F.array(x, F.lit(""))).otherwise(F.array(x))
        lines = F.concat(F.flatten(F.transform(lines, blank)), F.when(draw("after", 2) == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    number = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, DEPTH * i)]), name)
    whole = rows.select(F.struct(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("_role"), number.alias("_n")).alias("_of"), lines.alias("_lines"))
    at = whole.select("_of.*", F.posexplode("_lines").alias("at", "line"))
    return at.select("conv", "turn", "_role", "at", "line", (F.coalesce("_n", F.lit(DEPTH)) + F.least(F.col("at"), F.lit(DEPTH - 1))).cast("int").alias("state"))


def _learned(pieces: DataFrame, conversations: int) -> Model:
    """Count in at most so many transcripts, by hash order of their names; a table of counts comes to the driver."""
    chosen = pieces.select("conv").distinct().orderBy(F.xxhash64("conv"), F.col("conv").asc_nulls_first()).limit(conversations).withColumnRenamed("conv", "_conv")
    last = F.struct(F.element_at("states", -1).alias("state"), F.element_at("seen", -1).alias("shown"))
    rows = pieces.join(F.broadcast(chosen), F.col("conv").eqNullSafe(F.col("_conv"))).select("conv", "piece_id", F.col("rows.state").alias("states"), F.col("rows.shown").alias("seen"))
    rows = rows.withColumn("before", F.lag(last).over(W.partitionBy("conv").orderBy("piece_id")))

    def run(states, seen, before):
        out: Counter = Counter()
        for s, x, b in zip(states, seen, before):
            out.update(counted(s, x, b and (b["state"], b["shown"])))
        for what, n in out.items():
            yield *what, n

    parts = rows_operator(rows, ["states", "seen", "before"], run, "what string, a int, b int, at int, n long")
    found = parts.groupBy("what", "a", "b", "at").agg(F.sum("n").alias("n")).collect()
    return Model().learn({(r["what"], r["a"], r["b"], r["at"]): r["n"] for r in found})


def train(lines: DataFrame, conversations: int = MAX_TRAIN) -> Model:
    """A model of at most so many transcripts of from_turns() rows."""
    return _learned(_pieces(lines, shared_dir(lines.sparkSession)), conversations)


def _pieces(lines: DataFrame, path: str) -> DataFrame:
    """conv, piece_id and rows (id, line, state, shown): successive lines of a transcript, in the order of piece_id."""
    ensure_importable(lines.sparkSession)
    kind = lines.schema["conv"].dataType.simpleString()
    order = ["conv", "turn", "_role", "at", "line"]
    coded = partition_operator(
        lines.select(*order, "state"), lambda rows: ((*row, shown(row[4])) for row in rows),
        f"conv {kind}, turn {lines.schema['turn'].dataType.simpleString()}, _role string, at int, line string, state int, shown short",
    )
    # repeated rows are told apart, so that many of them are dealt to many tasks
    numbered = coded.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order, "_tie").withColumn("id", F.monotonically_increasing_id())
    pieces = numbered.groupBy("conv", F.shiftright("id", BLOCK.bit_length() - 1).alias("piece")).agg(
        F.min("id").alias("piece_id"), F.sort_array(F.collect_list(F.struct("id", "line", "state", "shown"))).alias("rows")
    )
    return cut(pieces.drop("piece"), f"{path}/pieces")


def _decoded(pieces: DataFrame, model: Model, path: str) -> DataFrame:
    """conv, line, state and found (the state that Viterbi finds for it in its whole transcript), each transcript in order within a partition."""
    shared = pieces.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        m = shared.value.prepare()
        for _, own in groupby(rows, lambda r: r[0]):
            ids, ends, seen = [], [0], array("h")
            for _, piece_id, part in own:
                ids.append(piece_id)
                seen.extend(part)
                ends.append(len(seen))
            states = m.path(seen)
            for piece_id, a, z in zip(ids, ends, ends[1:]):
                yield piece_id, list(states[a:z])

    told = pieces.select("conv", "piece_id", F.col("rows.shown").alias("shown")).repartition("conv").sortWithinPartitions("conv", "piece_id")
    found = cut(partition_operator(told, run, "piece_id long, found array<tinyint>"), f"{path}/found")
    both = pieces.join(found, "piece_id").repartition("conv").sortWithinPartitions("conv", "piece_id")
    return both.select("conv", F.inline(F.arrays_zip(F.col("rows.line").alias("line"), F.col("rows.state").alias("state"), "found")))


def _turns(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From (conv, line, state, found) in order: conv, turn_no, role, text, n_lines, n_right, n_unmarked, n_recalled of each turn."""
    for conv, own in groupby(rows, lambda r: r[0]):
        no, lines, states, right, unmarked, recalled = 0, [], [], 0, 0, 0
        for _, line, state, found in own:
            if lines and STATES[found][1] == 0:
                yield conv, no, *turns(lines, states)[0], len(lines), right, unmarked, recalled
                no, lines, states, right, unmarked, recalled = no + 1, [], [], 0, 0, 0
            lines.append(line)
            states.append(found)
            right += state == found
            if STATES[state][1] == 0 and not marker(line)[0] and line:
                unmarked, recalled = unmarked + 1, recalled + (state == found)
        yield conv, no, *turns(lines, states)[0], len(lines), right, unmarked, recalled


_COUNTS = "n_lines long, n_right long, n_unmarked long, n_recalled long"


def _transcripts(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From (conv, line, state, found) in order: conv, n_turns, the counts, roles, rendered_sha256 of each transcript."""
    for conv, own in groupby(_turns(rows), lambda r: r[0]):
        roles, counts, digest = [], [0, 0, 0, 0], hashlib.sha256()
        for _, _, role, text, *more in own:
            roles.append(role)
            counts = [a + b for a, b in zip(counts, more)]
            digest.update(render([(role, text)]).encode())
        yield conv, len(roles), *counts, ",".join(roles), digest.hexdigest()


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """Turns of each transcript: conv, turn_no, role, text, n_lines, n_right (lines whose state is the given one), n_unmarked (turns that begin without a marker there), n_recalled (of these, found with their role)."""
    kind = lines.schema["conv"].dataType.simpleString()
    at = shared_dir(lines.sparkSession)
    found = _decoded(_pieces(lines, at), model, at)
    return partition_operator(found, _turns, f"conv {kind}, turn_no long, role string, text string, {_COUNTS}")


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv, n_turns, n_lines, n_right, n_unmarked, n_recalled, roles, rendered_sha256."""
    at = shared_dir(rows.sparkSession)
    pieces = _pieces(from_turns(rows, conv, turn, role, text), at)
    kind = pieces.schema["conv"].dataType.simpleString()
    found = _decoded(pieces, _learned(pieces, MAX_TRAIN), at)
    return partition_operator(found, _transcripts, f"`{conv}` {kind}, n_turns long, {_COUNTS}, roles string, rendered_sha256 string")
