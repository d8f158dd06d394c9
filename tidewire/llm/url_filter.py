"""URL filters by a bit-parallel wildcard automaton.

All rules are globs over the canonical URL (host and path). Their states are
packed side by side into machine words; a byte advances every rule of every URL
of a block with a few bit operations: states whose literal matches shift on
(Shift-And, with carries between words) and states before a wildcard stay. A
whole batch of URLs runs at once, so the cost is bytes times words, whatever
the number of rules that a URL might fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import byte_slices

#: 64-bit words of state that are held at a time.
STATE_WORDS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[list[str]]:
        return [[self.name, "**"], ["*", "." + self.name, "**"]]


#: The rules of the production query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Where no rule fits, a URL that fits one of these is blocked and any other allowed.
BLOCKED = ("*casino*/**", "*poker*/**", "*viagra*/**", "*.xxx/**", "**/login*", "**/cart/**", "**.exe")


def parsed(glob: str) -> list[str]:
    """A glob as literals and wildcards: `*` is any run within the host or one part of the path, `**` any run at all."""
    out: list[str] = []
    rest = glob
    while rest:
        size = 2 if rest.startswith("**") else 1 if rest[0] == "*" else (rest + "*").index("*")
        out.append(rest[:size])
        rest = rest[size:]
    return out


class Automaton:
    """Globs, each a list of literals and wildcards, that must fit a whole byte string."""

    def __init__(self, globs: list[list[str]]) -> None:
        literals: list[bytes] = []
        stays: list[dict[int, bool]] = []
        for glob in globs:
            literal, stay = b"", {}
            for token in glob:
                if token in ("*", "**"):
                    stay[len(literal)] = stay.get(len(literal), False) or token == "**"
                else:
                    literal += token.encode()
            literals.append(literal)
            stays.append(stay)
        first = np.cumsum([0, *(len(x) + 1 for x in literals)])
        self.words = max(1, -(-int(first[-1]) // 64))
        self.start = np.zeros(self.words, np.uint64)
        self.moves, self.stays = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.accepts = []
        for at, literal, stay in zip(first.tolist(), literals, stays):
            self._set(self.start, at)
            for k, byte in enumerate(literal):
                self._set(self.moves[byte], at + k)
            for k, slash in stay.items():
                word, bit = divmod(at + k, 64)
                self.stays[:, word] |= np.uint64(1) << np.uint64(bit)
                if not slash:
                    self.stays[ord("/"), word] &= ~(np.uint64(1) << np.uint64(bit))
            self.accepts.append(divmod(at + len(literal), 64))

    @staticmethod
    def _set(mask: np.ndarray, state: int) -> None:
        mask[state // 64] |= np.uint64(1) << np.uint64(state % 64)

    def fits(self, texts: list[bytes]) -> np.ndarray:
        """(texts, globs): which globs fit which texts."""
        out = np.zeros((len(texts), len(self.accepts)), bool)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        step = max(1, STATE_WORDS // self.words)
        for a in range(0, len(order), step):
            block = order[a : a + step]
            out[block] = self._run([texts[i] for i in block.tolist()])
        return out

    def _run(self, texts: list[bytes]) -> np.ndarray:
        """texts: longest first."""
        lengths = np.array([len(t) for t in texts])
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum(lengths) - lengths
        state = np.repeat(self.start[None], len(texts), axis=0)
        live = len(texts)
        for at in range(int(lengths[0]) if len(texts) else 0):
            while live and lengths[live - 1] <= at:
                live -= 1
            byte = flat[begin[:live] + at]
            now = state[:live]
            moved = now & self.moves[byte]
            shifted = moved << np.uint64(1)
            shifted[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            state[:live] = shifted | (now & self.stays[byte])
        return np.stack([(state[:, w] >> np.uint64(b)) & np.uint64(1) for w, b in self.accepts], axis=1).astype(bool)


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#` or the end. Both empty without `://`."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    head = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(head, "/", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.when(F.instr(head, "/") > 0, F.substring(head, F.instr(head, "/"), F.length(head))).otherwise("")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row.

    The longest rule that fits gives `rule` and the verdict (of equally long
    ones the first). Where none fits, `rule` is null and the verdict is block
    if a glob of `blocked` fits host and path, else allow. A null URL or one
    without `://` has an empty host and path, which no rule fits. Null and
    repeated ids keep their rows; other columns play no part.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        globs = [(k, g) for k, r in enumerate(ranked) for g in r.globs()] + [(len(ranked), parsed(b)) for b in blocked]
        automaton = Automaton([g for _, g in globs])
        owner = np.array([k for k, _ in globs], np.int64)
        names = np.array([r.name for r in ranked] + [None, None], object)
        verdicts = np.array([r.verdict for r in ranked] + ["block", "allow"], object)
        for batch in batches:
            for part in byte_slices(batch, "path"):
                urls = pc.binary_join_element_wise(part.column("host"), part.column("path"), "").cast(pa.binary()).to_pylist()
                fits = automaton.fits(urls) if owner.size else np.zeros((len(urls), 0), bool)
                best = np.where(fits.any(axis=1), owner[fits.argmax(axis=1)], len(ranked) + 1) if owner.size else np.full(len(urls), len(ranked) + 1)
                columns = [part.column(c) for c in ("id", "host", "path")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())], ["id", "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path("url")
    out = pages.select("id", host.alias("host"), path.alias("path")).mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
