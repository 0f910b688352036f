"""Chat formatting: speaker roles of a transcript's lines by a hidden Markov model, then canonical turns.

Hidden states are (role, first line of a turn or a later one); a line is observed as its speaker marker and a few
features (blank line before, question mark, length). Start, transition and emission probabilities are counts over
transcripts with known roles. Viterbi gives the likeliest roles, also of lines without a marker.

Rows: null texts count as empty and keep their line, but a transcript of blank lines has no turn; an id of null is a transcript of its own; repeated rows are
repeated lines, ordered by seq and then text; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship

ROLES = ["system", "user", "assistant"]
STATES = [(r, k) for r in range(3) for k in range(2)]  # k 0: first line of a turn, 1: later line
MARK = re.compile(r"^\s*(?:#{1,3}\s*|\[|<\|?|\*\*)?(system|instructions?|user|human|question|q|assistant|bot|ai|answer|a)(?:\|?>|\]|\*\*)?\s*[:>]\s*", re.I)
ROLE_OF = {"system": 0, "instruction": 0, "instructions": 0, "user": 1, "human": 1, "question": 1, "q": 1, "assistant": 2, "bot": 2, "ai": 2, "answer": 2, "a": 2}
OBS = 4 * 2 * 2 * 4


def observe(line: str, blank_before: bool) -> tuple[int, str]:
    """(number of the observation, line without its marker)."""
    m = MARK.match(line)
    mark = 1 + ROLE_OF[m[1].lower()] if m else 0
    rest = line[m.end() :] if m else line
    size = min(3, len(rest).bit_length() // 4)
    return ((mark * 2 + blank_before) * 2 + rest.rstrip().endswith("?")) * 4 + size, rest


class Hmm:
    def __init__(self, start: np.ndarray, turn: np.ndarray, emit: np.ndarray):
        self.start, self.turn, self.emit = start, turn, emit

    @staticmethod
    def fit(sequences: list[tuple[list[int], list[int]]]) -> Hmm:
        """sequences of (observations, states); add-one smoothing, and a continuation never changes the role."""
        n = len(STATES)
        start, turn, emit = np.ones(n), np.full((n, n), 0.5), np.full((n, OBS), 0.05)
        for obs, states in sequences:
            if states:
                start[states[0]] += 1
            for a, b in zip(states, states[1:]):
                turn[a, b] += 1
            for o, s in zip(obs, states):
                emit[s, o] += 1
        for a, (ra, _) in enumerate(STATES):
            for b, (rb, k) in enumerate(STATES):
                if k == 1 and ra != rb:
                    turn[a, b] = 1e-12
        start[[i for i, (_, k) in enumerate(STATES) if k == 1]] = 1e-12
        log = lambda m: np.log(m / m.sum(-1, keepdims=True))
        return Hmm(log(start), log(turn), log(emit))

    def viterbi(self, obs: list[int]) -> list[int]:
        if not obs:
            return []
        back = np.zeros((len(obs), len(STATES)), np.int8)
        score = self.start + self.emit[:, obs[0]]
        for t in range(1, len(obs)):
            reach = score[:, None] + self.turn
            back[t] = reach.argmax(0)
            score = reach.max(0) + self.emit[:, obs[t]]
        path = [int(score.argmax())]
        for t in range(len(obs) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return path[::-1]


class Decoder:
    """Viterbi over lines as they come, on the same scores as Hmm.viterbi: whenever the best paths to all states have a
    common beginning, the lines of it are decided and need not be held."""

    def __init__(self, model: Hmm, every: int = 500):
        self.model, self.every = model, every
        self.score, self.back, self.held = None, [], []

    def feed(self, obs: int, line: tuple) -> list[tuple[int, tuple]]:
        """The lines that are decided by now, in order, with their states."""
        if self.score is None:
            self.score = self.model.start + self.model.emit[:, obs]
        else:
            reach = self.score[:, None] + self.model.turn
            self.back.append(reach.argmax(0))
            self.score = reach.max(0) + self.model.emit[:, obs]
        self.held.append(line)
        return self.decided() if len(self.held) % self.every == 0 else []

    def decided(self) -> list[tuple[int, tuple]]:
        alive = set(range(len(STATES)))
        for t in range(len(self.back) - 1, -1, -1):
            alive = {int(self.back[t][s]) for s in alive}
            if len(alive) == 1:
                out = self.path(alive.pop(), t)
                self.back, self.held = self.back[t + 1 :], self.held[t + 1 :]
                return out
        return []

    def path(self, state: int, t: int) -> list[tuple[int, tuple]]:
        """Of the held lines 0 to t, if the last has this state."""
        states = [state]
        for k in range(t - 1, -1, -1):
            states.append(int(self.back[k][states[-1]]))
        return list(zip(states[::-1], self.held[: t + 1]))

    def finish(self) -> list[tuple[int, tuple]]:
        out = self.path(int(self.score.argmax()), len(self.held) - 1) if self.held else []
        self.score, self.back, self.held = None, [], []
        return out


def split_lines(chunks: list[str]) -> tuple[list[int], list[tuple[list[str], str, str]], list[int], list[str]]:
    """(observations, (blank lines before, raw line, line without its marker) of each, chunk of each, blank lines after
    the last); blank lines are not observed, they only mark what follows them."""
    obs, lines, of = [], [], []
    blanks: list[str] = []
    for i, c in enumerate(chunks):
        for line in (c or "").split("\n"):
            if not line.strip():
                blanks.append(line)
                continue
            o, rest = observe(line, not lines or bool(blanks))
            obs.append(o)
            lines.append((blanks, line, rest))
            of.append(i)
            blanks = []
    return obs, lines, of, blanks


def turns(chunks: Iterable[str], model: Hmm, every: int = 500) -> Iterator[tuple[str, str]]:
    """Turns (role, text) of one transcript, with their blank lines, as soon as they are decided: lines and turns that are
    are not held. A marker goes only where a turn begins; without one, the blank line before a turn is its mark and goes."""
    decoder, role, text, blanks, some = Decoder(model, every), None, [], [], False

    def told(decided: list) -> Iterator[tuple[str, str]]:
        nonlocal role, text
        for s, (before, line, rest) in decided:
            now, later = STATES[s]
            if later and role is not None:
                text += [*before, line]
                continue
            if rest == line:
                before = before[:-1]
            if role is not None:
                yield ROLES[role], "\n".join([*text, *before])
                before = []
            role, text = now, [*before, rest]

    for c in chunks:
        for line in (c or "").split("\n"):
            if not line.strip():
                blanks.append(line)
                continue
            o, rest = observe(line, not some or bool(blanks))
            yield from told(decoder.feed(o, (blanks, line, rest)))
            some, blanks = True, []
    yield from told(decoder.finish())
    if role is not None:
        yield ROLES[role], "\n".join([*text, *blanks])


def parse(chunks: list[str], model: Hmm) -> list[tuple[str, str]]:
    """All turns of one transcript."""
    return list(turns(chunks, model))


def learn(known: DataFrame, marked: Column, max_rows: int = 20_000) -> Hmm:
    """known (id, seq, role, text), marked: the raw chunk of a row. Fits on the transcripts of at most max_rows rows,
    the least by hash of their id; the last of them is left out if the bound may have cut it, unless it is the only one."""
    rows = known.select("id", "seq", "role", marked.alias("raw")).orderBy(F.xxhash64("id"), "id", "seq", "raw").limit(max_rows).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    if len(rows) == max_rows and len(by) > 1:
        by.pop(rows[-1].id)
    sequences = []
    for part in by.values():
        obs, _, of, _ = split_lines([r.raw for r in part])
        states = [STATES.index((ROLES.index(part[c].role), 0 if i == 0 or of[i - 1] != c else 1)) if part[c].role in ROLES else 2 for i, c in enumerate(of)]
        sequences.append((obs, states))
    return Hmm.fit(sequences)


def format_chats(transcripts: DataFrame, model: Hmm) -> DataFrame:
    """transcripts (id, seq, text): chunks of raw text in order. Gives (id, turn, role, text, rendered).

    A transcript's chunks are sorted by Spark and pass through one task once: a chain is decoded in order. The task holds
    the lines that are not decided and the turn that goes on, not the transcript."""
    ship(transcripts.sparkSession)
    kind = transcripts.schema["id"].dataType.simpleString()
    columns = ["id", "turn", "role", "text", "rendered"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(b["id"].astype(object).where(b["id"].notna(), None), b["text"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for now, group in groupby(rows(batches), key=lambda r: r[0]):
            for i, (r, t) in enumerate(turns((t for _, t in group), model)):
                out.append((now, i, r, t, f"<|{r}|>\n{t}<|end|>"))
                size += len(t)
                if size > 1 << 20 or len(out) == 1000:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)

    return transcripts.select("id", "seq", "text").repartition("id").sortWithinPartitions("id", "seq", "text").mapInPandas(run, f"id {kind}, turn long, role string, text string, rendered string")
