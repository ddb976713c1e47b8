"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And machine: one bit per
rule start and per literal byte.  A step for byte ``c`` is
``D = ((D << 1) & B[c]) | (D & L[c])``, with ``B`` the literal positions and
``L`` the positions where a wildcard loops.  A batch of URLs is stepped
together, one byte column at a time, so every URL and every rule advance in the
same few array operations whatever the number of rules.

Globs are matched against the canonical form ``.host/path``: ``*`` runs over
any bytes but ``/`` and ``**`` over any bytes.  The canonical host is in small
letters, without user, port and final dot; in the canonical path unreserved
characters stand for themselves, not percent-encoded.  Explicit rules are matched
against host and path as reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

ALLOW, BLOCK = "allow", "block"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class Rule:
    """An explicit host-and-path rule; the longest one that fits decides."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


#: The explicit rules of the production filter.
RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)

# Globs that block a URL that no explicit rule fits, by reason.
_HOST_LABELS = {
    "advertising": "ad ads adserver adservice advert banner banners popup popups sponsor",
    "tracking": "analytics beacon click clicks metrics pixel stats telemetry track tracker tracking",
    "gambling": "bet betting bingo casino jackpot lottery poker roulette slots",
    "adult": "adult escort nude porn sex xxx",
    "junk": "cheap coupon free loan pills replica spam viagra warez",
}
_PATH_PARTS = {
    "advertising": "ads adclick banners popup",
    "account": "login logout signin signup register password account wp-admin wp-login.php",
    "shop": "basket cart checkout wishlist",
    "machine": "cgi-bin cdn-cgi xmlrpc.php trackback",
}
_ENDINGS = "7z apk avi bin bmp css dmg exe gif gz ico iso jar jpeg jpg js mov mp3 mp4 msi ogg png rar rss svg tar tgz ttf wav webm webp woff woff2 zip"


def production_globs() -> tuple[str, ...]:
    """Hosts below a registered domain with a label that is a listed word or begins with one and a dash, paths with a listed part, and endings of files without text.

    The domain itself is never judged by its name: at least two labels follow.
    """
    out = []
    for words in _HOST_LABELS.values():
        for w in words.split():
            out += [f"*.{w}.*.**", f"*.{w}-*.*.**"]
    for words in _PATH_PARTS.values():
        for w in words.split():
            out += [f"**/{w}", f"**/{w}/**"]
    return tuple(out + [f"*/**.{w}" for w in _ENDINGS.split()])


BLOCK_GLOBS = production_globs()


def globs_of_list(lines: Sequence[str]) -> tuple[str, ...]:
    """Globs of a filter list: ``||host^`` and ``||host/path`` fit a host with all below it, other lines are globs; blank lines and those after ``!`` or ``#`` are comments."""
    out = []
    for line in (x.strip() for x in lines):
        if not line or line[0] in "!#":
            continue
        if not line.startswith("||"):
            out.append(line)
            continue
        host, slash, path = line[2:].removesuffix("^").partition("/")
        host = host.translate(_LOWER)
        out += [f"*.{host}/{path}**"] if slash else [f"*.{host}", f"*.{host}/**"]
    return tuple(out)

#: Longest strings of a batch that are not stepped together with the others.
ALONE = 2

_SCHEME_REST = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_UNRESERVED = re.compile(r"%(2[DEde]|3[0-9]|4[1-9A-Fa-f]|5[0-9AaFf]|6[1-9A-Fa-f]|7[0-9AaEe])")
_PORT = re.compile(r":[0-9]*\Z")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host up to ``/``, ``?``, ``#`` or the end with A-Z lower-cased, path up to ``?`` or ``#``."""
    m = _SCHEME_REST.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def canonical_host(host: str) -> str:
    """A host of ``split_url`` without user, port and final dot."""
    return _PORT.sub("", host.rpartition("@")[2]).removesuffix(".")


def canonical_path(path: str) -> str:
    """A path with its percent-encoded letters, digits and ``-._~`` decoded, once."""
    return _UNRESERVED.sub(lambda m: chr(int(m[1], 16)), path) if "%" in path else path


class ShiftAnd:
    """Multiword Shift-And machine of glob patterns."""

    def __init__(self, globs: Sequence[str]):
        literal: list[tuple[int, int]] = []  # (bit, byte)
        loops: list[tuple[int, bool]] = []  # (bit, also over '/')
        starts, self.finals, bit = [], [], 0
        for g in globs:
            starts.append(bit)
            for part in re.findall(r"\*\*|\*|[^*]+", g):
                if part[0] == "*":
                    loops.append((bit, part == "**"))
                else:
                    for b in part.encode():
                        bit += 1
                        literal.append((bit, b))
            self.finals.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.begin = np.zeros(self.words, np.uint64)
        self.literal = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        for at in starts:
            self._set(self.begin, at)
        for at, b in literal:
            self._set(self.literal[b], at)
        for at, slash in loops:  # a bit may carry both wildcards
            for b in range(256):
                if slash or b != ord("/"):
                    self._set(self.loop[b], at)

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)

    def _finish(self, state: np.ndarray, rest: bytes) -> np.ndarray:
        """State after ``rest``, one string alone: its words as one number."""
        number = lambda words: int.from_bytes(words.astype("<u8").tobytes(), "little")
        literal, loop = ([number(t[b]) for b in range(256)] for t in (self.literal, self.loop))
        d = number(state)
        for b in rest:
            d = (d << 1) & literal[b] | d & loop[b]
        return np.frombuffer(d.to_bytes(8 * self.words, "little"), "<u8")

    def run(self, strings: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix (string, pattern): whether the pattern matches the whole string."""
        n = len(strings)
        state = np.tile(self.begin, (n, 1))
        sizes = np.fromiter(map(len, strings), np.int64, n)
        data = np.frombuffer(b"".join(strings), np.uint8)
        offsets = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")  # longest first: those still running are a prefix
        sizes, offsets, one, top = sizes[order], offsets[order], np.uint64(1), np.uint64(63)
        # the few strings that are much longer than all others go on one by one
        common = int(sizes[ALONE]) if n > ALONE else 0
        for at in range(common):
            live = int(np.searchsorted(-sizes, -at, side="left"))
            c = data[offsets[:live] + at]
            now = state[:live]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:live] = (shifted & self.literal[c]) | (now & self.loop[c])
        for k in range(min(n, ALONE)):
            state[k] = self._finish(state[k], data[offsets[k] + common : offsets[k] + sizes[k]].tobytes())
        hits = np.zeros((n, len(self.finals)), bool)
        for k, bit in enumerate(self.finals):
            hits[order, k] = (state[:, bit >> 6] >> np.uint64(bit & 63)) & one != 0
        return hits


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, block_globs: Sequence[str] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict on every URL.

    Returns one row per input row: page_id, host, path, rule (host and path of
    the longest explicit rule that fits, else null) and verdict (the rule's, else
    block if a glob matches and allow otherwise).  A null URL or one without
    ``://`` has empty host and path, fits no rule and is allowed; a null id
    stays null; repeated rows give repeated results; other columns are ignored;
    an empty table gives an empty table.  URLs are matched whole.  Of equally
    long rules the one listed first decides.
    """
    bounded_batches(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [r.glob for r in ranked] + list(block_globs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ShiftAnd(globs)
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            hits = machine.run([f".{h}{p}".encode() for h, p in parts])
            # few hosts have a user, a port or a final dot, and few paths are encoded
            other = [(i, c) for i, p in enumerate(parts) if (c := (canonical_host(p[0]), canonical_path(p[1]))) != p]
            if other:
                again = machine.run([f".{h}{p}".encode() for _, (h, p) in other])
                hits[[i for i, _ in other], len(ranked) :] = again[:, len(ranked) :]
            names, verdicts = [], []
            for row in hits:
                fit = next((r for r, hit in zip(ranked, row, strict=False) if hit), None)
                names.append(fit.name if fit else None)
                verdicts.append(fit.verdict if fit else BLOCK if row[len(ranked) :].any() else ALLOW)
            yield pa.record_batch([b.column(0), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], names, verdicts))], names=["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
