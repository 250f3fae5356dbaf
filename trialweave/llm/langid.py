"""Language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built. A text is parsed greedily against it: the
longest match that occurs in the labelled text is one phrase, then parsing goes on behind it. The number of
phrases times the bits of a pointer into the labelled text, per letter, estimates the cross entropy; the
language with the fewest normalised phrases wins, ties go to the first language by name.

Texts are lower-cased; every run of non-letters counts as one space. Parsing restarts after each
``BLOCK`` letters, which adds at most one phrase per block for every language and lets all blocks of a slice
of texts step through the automata side by side. Whole texts are parsed.

The labelled text is a bounded sample: ``sample_docs`` documents a language by hash order, of each a piece of
``doc_letters`` characters that begins at a hashed place. These two are the only bounds, and they hold for
fitting alone. An automaton is a double array: the transitions of all states share one array of about as many
entries as there are transitions, so its size follows the sample, not the alphabet. Languages are assumed to be a closed list that fits the driver, as labels are.

``lang_pred`` is ``und`` with score 0 for null or letterless text and wherever no language was learned.
Rows are judged one by one, so repeated rows get equal results; other columns are kept.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .kernels import release

BLOCK = 256
SLICE_LETTERS = 1 << 19


@dataclass
class Automaton:
    """Transitions as a double array: the one of state s by code c is at ``base[s] + c`` if ``owner`` there is s."""

    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    start: np.ndarray  # state after each code alone; 0 is the start state

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and where there is none."""
        at = self.base[state] + codes
        return self.target[at], self.owner[at] != state


def packed(step: list[dict[int, int]], width: int, tries: int = 32) -> Automaton:
    """Rows with most transitions are placed first; the search begins at a cursor that leaves dense parts behind.

    Single transitions, which fit anywhere, fill the holes.
    """
    size = sum(map(len, step)) + width
    owner = [-1] * (3 * size + 2 * width)
    target, base = [0] * len(owner), [0] * len(step)
    free = cursor = width  # the least slot that may be free (a base is not negative), and where longer rows are tried
    for state in sorted(range(len(step)), key=lambda s: -len(step[s])):
        row = sorted(step[state].items())
        if not row:
            continue
        low, at, tried = row[0][0], cursor if len(row) > 1 else free, 0
        while any(owner[at - low + c] >= 0 for c, _ in row):
            at, tried = at + 1, tried + 1
            if tried > tries:
                cursor = at
            if at + 2 * width > len(owner):
                owner += [-1] * size
                target += [0] * size
        base[state] = at - low
        for c, to in row:
            owner[at - low + c], target[at - low + c] = state, to
        while owner[free] >= 0:
            free += 1
    reach = max(base) + width
    owner += [-1] * max(0, reach - len(owner))
    target += [0] * max(0, reach - len(target))
    start = np.array([step[0].get(c, 0) for c in range(width)], np.int32)
    return Automaton(np.array(base, np.int32), np.array(owner[:reach], np.int32), np.array(target[:reach], np.int32), start)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters; found once in a worker."""
    return np.array([unicodedata.category(chr(point))[0] == "L" for point in range(0x110000)])


@dataclass
class LanguageModel:
    languages: list[str]
    alphabet: str  # letters seen in the samples; code 0 is space, codes follow the string
    tables: list[Automaton]
    sizes: list[int]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def _spaced(text: str) -> str:
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def build(samples: dict[str, str]) -> LanguageModel:
    """Automata of one sample text per language."""
    texts = {lang: _spaced(text) for lang, text in sorted(samples.items())}
    texts = {lang: text for lang, text in texts.items() if text}
    alphabet = "".join(sorted(set("".join(texts.values())) - {" "}))
    code = {c: i + 1 for i, c in enumerate(alphabet)} | {" ": 0}
    tables = []
    for text in texts.values():
        # two more codes: a letter never seen (no match), and padding
        tables.append(packed(suffix_automaton([code[c] for c in text]), len(alphabet) + 3))
    return LanguageModel(list(texts), alphabet, tables, [len(t) for t in texts.values()])


def fit(
    documents: DataFrame, usable: Column, sample_docs: int = 300, doc_letters: int = 200
) -> LanguageModel:
    """Learn from the rows of ``documents`` where ``usable`` holds and text and lang are not null."""
    rows = documents.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel([], "", [], [])
    scale = 1 << 30
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(scale))
    # twice the wanted share, so that the wanted number is there; the rest is cut off below
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(scale, 2 * scale * sample_docs // n + 1))).otherwise(share)
    first = F.pmod(F.xxhash64("doc_id", F.lit(18)), F.greatest(F.length("text") - doc_letters, F.lit(0)) + 1).cast("int") + 1
    piece = F.col("text").substr(first, F.lit(doc_letters)).alias("text")
    picked = rows.filter(place < share).select("lang", place.alias("place"), piece)
    texts: dict[str, list[str]] = {}
    for row in sorted(picked.distinct().collect()):
        texts.setdefault(row["lang"], []).append(row["text"])
    return build({k: " ".join(dict.fromkeys(v[:sample_docs])) for k, v in texts.items()})


class Parser:
    """Cross-parses many texts at once."""

    def __init__(self, model: LanguageModel):
        self.model = model
        unknown, self.pad = len(model.alphabet) + 1, len(model.alphabet) + 2
        code = _letters() * np.int32(unknown)
        for i, c in enumerate(model.alphabet):
            code[ord(c)] = i + 1
        self.code = code

    def blocks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes in blocks [BLOCK, lanes], the text of each lane, letters and spaces per text."""
        joined = "\0".join(texts).lower()  # NUL is no letter; lower() may change lengths, so cut by it
        raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        codes = self.code[raw]
        border = raw == 0
        if int(border.sum()) != len(texts) - 1:  # a NUL within a text
            raise ValueError("texts must not hold NUL")
        keep = codes != 0
        keep[1:] |= codes[:-1] != 0  # the first non-letter behind a letter stays as a space
        text_of = np.cumsum(border)
        codes, text_of = codes[keep & ~border], text_of[keep & ~border]
        length = np.bincount(text_of, minlength=len(texts))
        first = np.cumsum(length) - length
        inside = np.arange(len(codes)) - first[text_of]
        n_blocks = -(-length // BLOCK)
        lane_of_text = np.cumsum(n_blocks) - n_blocks
        out = np.full((BLOCK, int(n_blocks.sum())), self.pad, np.int32)
        out[inside % BLOCK, lane_of_text[text_of] + inside // BLOCK] = codes
        return out, np.repeat(np.arange(len(texts)), n_blocks), length

    def phrases(self, blocks: np.ndarray, table: Automaton) -> np.ndarray:
        """Phrases of each lane."""
        state = np.zeros(blocks.shape[1], np.int32)
        count = np.ones(blocks.shape[1], np.int32)
        for codes in blocks:
            ahead, ended = table.step(state, codes)
            count += ended & (codes < self.pad)  # padding stands at the end of a lane
            state = np.where(ended, table.start[codes], ahead)
        return count

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        blocks, text_of, length = self.blocks(texts)
        if not self.model.languages or not blocks.shape[1]:
            return ["und"] * len(texts), [0.0] * len(texts)
        bits = np.stack(
            [
                np.bincount(text_of, self.phrases(blocks, table), len(texts)) * np.log2(size + 1)
                for table, size in zip(self.model.tables, self.model.sizes)
            ]
        )
        best = bits.argmin(axis=0)
        if len(bits) > 1:
            low = np.partition(bits, 1, axis=0)[:2]
            score = np.divide(low[1], low[0] + low[1], out=np.zeros(len(texts)), where=length > 0)
        else:
            score = np.ones(len(texts))
        letters = np.bincount(text_of, ((blocks > 0) & (blocks < self.pad)).sum(axis=0), len(texts)) > 0
        names = [self.model.languages[b] if has else "und" for b, has in zip(best, letters)]
        return names, np.where(letters, score, 0.0).tolist()


def identify(documents: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add lang_pred string and score double (under ``names``) to ``documents``; columns of these names are replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c not in names]
    frame = documents.select(*[F.col(f"`{c}`") for c in kept])
    where = kept.index("text")
    schema = frame.withColumns({names[0]: F.lit("").cast("string"), names[1]: F.lit(0.0)}).schema

    def run(batches):
        parser = None
        for batch in batches:
            if parser is None:
                parser = Parser(shared.value)
            found, scores, part, held = [], [], [], 0
            for i, text in enumerate(batch.column(where)):
                part.append((text.as_py() or "").replace("\0", " "))
                held += len(part[-1])
                if held >= SLICE_LETTERS or i == batch.num_rows - 1:
                    a, b = parser.predict(part)
                    found, scores, part, held = found + a, scores + b, [], 0
            columns = [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])
        parser = None
        release()

    return frame.mapInArrow(run, schema)
