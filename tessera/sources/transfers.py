"""Block OTAs: transfer lists as tables, and the block store that their commands change in order.

Each line becomes a Step by the grammar of its command, and is checked whole, before anything runs. Steps of one partition
depend on one another (later ones read what earlier ones wrote), so a partition is one group of applyInArrow, its steps
in order; partitions run in parallel. Blocks are rows of a numpy array, so that ranges are index arrays and a step is
one gather and one scatter.

A null text is an empty list, and is refused as such; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import string
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import batches
from ..errors import FormatError
from .images import need
from .patches import apply_patch

BLOCK = 4096
#: What follows each command. b: blocks, d: SHA-1, n: number, s: source.
GRAMMAR = {"new": "b", "zero": "b", "erase": "b", "stash": "db", "free": "d", "move": "dbs", "bsdiff": "nnddbs", "imgdiff": "nnddbs"}
_LABEL = set(string.ascii_letters + string.digits + "_-")


def ranges(text: str) -> np.ndarray:
    """The block numbers of a range set `n,a,b,...`, in its order."""
    try:
        numbers = np.array([int(x) for x in text.split(",")], np.int64)
    except (ValueError, OverflowError) as e:
        raise FormatError(f"not a range set: {text}") from e
    low, high = numbers[1::2], numbers[2::2]
    need(numbers[0] == len(numbers) - 1 and len(low) == len(high), f"not a range set: {text}")
    need(bool(((low >= 0) & (low < high)).all()), f"range set is out of order: {text}")
    by = np.argsort(low)
    need(bool((high[by][:-1] <= low[by][1:]).all()), f"range set overlaps: {text}")
    n = high - low
    return np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


@dataclass
class Step:
    """A command: what it writes, the part of the patch data, digests, and the pieces of its source: (a stash, or None for
    the image; blocks of the image; places in the buffer)."""

    command: str
    target: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    numbers: list[int] = field(default_factory=list)
    digests: list[str] = field(default_factory=list)
    pieces: list[tuple[str | None, np.ndarray, np.ndarray]] = field(default_factory=list)
    blocks: int = 0

    def writes(self) -> bool:
        return self.command not in ("stash", "free")


def _source(step: Step, tokens: list[str]) -> None:
    """`count ranges`, `count ranges places stash:places ...` or `count - stash:places ...`"""
    need(len(tokens) > 1 and tokens[0].isdecimal(), "bad source")
    step.blocks, stashes = int(tokens[0]), tokens[3:]
    if tokens[1] == "-":
        stashes = tokens[2:]
    else:
        from_ = ranges(tokens[1])
        step.pieces.append((None, from_, ranges(tokens[2]) if len(tokens) > 2 else np.arange(len(from_))))
    for token in stashes:
        label, colon, places = token.partition(":")
        need(colon == ":" and label, f"bad stash {token}")
        step.pieces.append((label, np.zeros(0, np.int64), ranges(places)))
    need(all(label is not None or len(a) == len(b) for label, a, b in step.pieces), "a piece of the source has two sizes")
    places = np.sort(np.concatenate([np.zeros(0, np.int64), *(p[2] for p in step.pieces)]))
    need(len(places) == step.blocks and bool((places == np.arange(step.blocks)).all()), "pieces don't make up the source")


def step_of(tokens: list[str]) -> Step:
    command, rest = tokens[0], list(tokens[1:])
    need(command in GRAMMAR, f"command {command} is not known")
    step = Step(command)
    for kind in GRAMMAR[command]:
        need(rest, f"{command} is cut short")
        if kind == "s":
            _source(step, rest)
            rest = []
            continue
        token = rest.pop(0)
        if kind == "b":
            step.target = ranges(token)
        elif kind == "d":
            need(len(token) == 40 and set(token) <= set(string.hexdigits) or command == "free", f"bad digest {token}")
            step.digests.append(token.lower())
        else:
            need(token.isdecimal(), f"bad number {token}")
            step.numbers.append(int(token))
    need(not rest, f"{command} has too many words")
    need(command != "move" or step.blocks == len(step.target), "move has two sizes")
    return step


def _parsed(name: str, text: str | None) -> list[tuple[int, list[str], Step]]:
    need(name and set(name) <= _LABEL, f"bad partition name {name!r}")
    lines = [x.split() for x in (text or "").splitlines() if x.strip()]
    head = [x[0] for x in lines[:4] if len(x) == 1 and x[0].removeprefix("-").isdecimal()]
    need(len(head) == 4, f"{name}: bad header")
    need(head[0] in ("3", "4") and int(head[1]) > 0, f"{name}: version is not supported")
    return [(seq, tokens, step_of(tokens)) for seq, tokens in enumerate(lines[4:])]


def parse(name: str, text: str | None) -> list[tuple[int, str, list[str]]]:
    """(seq, command, tokens) of a transfer list of version 3 or 4, each checked."""
    return [(seq, tokens[0], tokens[1:]) for seq, tokens, _ in _parsed(name, text)]


def commands(lists: DataFrame, name: str = "partition", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(partition, seq, command, tokens, target_end, keep): the lists' commands; target_end: the block behind the last one
    written; keep: columns of the lists that stay with them."""

    def run(rows):
        for label, raw, *more in rows:
            for seq, tokens, step in _parsed(label, raw):
                yield label, seq, tokens[0], tokens[1:], int(step.target.max(initial=-1)) + 1 if step.writes() else 0, *more

    schema = "partition string, seq int, command string, tokens array<string>, target_end long" + "".join(f", {c} {lists.schema[c].dataType.simpleString()}" for c in keep)
    return batches.mapped(lists.select(F.col(name), F.col(text), *keep), run, schema)


def unsound(steps: list[Step], new: int, patch: int) -> str | None:
    """What would fail while the steps run, known beforehand: streams of other sizes, and stashes that aren't there or have
    another size when they are read."""
    if sum(len(s.target) for s in steps if s.command == "new") * BLOCK != new:
        return "new data has another size than the commands take"
    held: dict[str, int] = {}
    for step in steps:
        if step.command == "imgdiff":
            return "imgdiff is not supported"
        if step.command == "bsdiff" and not (step.numbers[1] and sum(step.numbers) <= patch):
            return "patch data is cut short"
        if step.command == "stash" and held.setdefault(step.digests[0], len(step.target)) != len(step.target):
            return f"stash {step.digests[0]} has two sizes"
        if step.command == "free":
            held.pop(step.digests[0], None)
        missing = [label for label, _, places in step.pieces if label is not None and held.get(label) != len(places)]
        if missing:
            return f"no stash {missing[0]} of that size"
    return None


class Store:
    """One partition's blocks, its stashes, and the streams that steps read."""

    def __init__(self, image: bytes, new: bytes, patch: bytes, blocks: int, verify: bool):
        self.blocks = np.zeros((max(blocks, -(-len(image) // BLOCK)), BLOCK), np.uint8)
        self.blocks.reshape(-1)[: len(image)] = np.frombuffer(image, np.uint8)
        self.had = -(-len(image) // BLOCK)
        self.new, self.patch, self.verify, self.used = memoryview(new), patch, verify, 0
        self.stashes: dict[str, np.ndarray] = {}

    def checked(self, data: bytes, digest: str, what: str) -> None:
        need(not self.verify or hashlib.sha1(data).hexdigest() == digest, f"{what} hash differs")

    def taken(self, at: np.ndarray) -> np.ndarray:
        need(int(at.max(initial=-1)) < self.had, "read outside the image")
        return self.blocks[at]

    def put(self, at: np.ndarray, data) -> None:
        self.blocks[at] = data
        self.had = max(self.had, int(at.max(initial=-1)) + 1)

    def source(self, step: Step, digest: str) -> np.ndarray:
        buffer = np.empty((step.blocks, BLOCK), np.uint8)
        for label, at, places in step.pieces:
            need(label is None or label in self.stashes, f"no stash {label}")
            data = self.taken(at) if label is None else self.stashes[label]
            need(len(data) == len(places), f"stash {label} has another size")
            buffer[places] = data
        self.checked(buffer.tobytes(), digest, "source")
        return buffer

    def run(self, step: Step) -> None:
        getattr(self, "do_" + step.command)(step)

    def do_new(self, step: Step) -> None:
        n = len(step.target) * BLOCK
        need(self.used + n <= len(self.new), "new data is cut short")
        self.put(step.target, np.frombuffer(self.new[self.used : self.used + n], np.uint8).reshape(-1, BLOCK))
        self.used += n

    def do_zero(self, step: Step) -> None:
        self.put(step.target, 0)

    do_erase = do_zero

    def do_stash(self, step: Step) -> None:
        (label,) = step.digests
        if label not in self.stashes:
            data = self.taken(step.target)
            self.checked(data.tobytes(), label, "stash")
            self.stashes[label] = data

    def do_free(self, step: Step) -> None:
        self.stashes.pop(step.digests[0], None)

    def do_move(self, step: Step) -> None:
        self.put(step.target, self.source(step, step.digests[0]))

    def do_bsdiff(self, step: Step) -> None:
        at, n = step.numbers
        need(0 < n and at + n <= len(self.patch), "patch data is cut short")
        before, after = step.digests
        out = apply_patch(self.source(step, before).tobytes(), self.patch[at : at + n], len(step.target) * BLOCK)
        self.checked(out, after, "target")
        self.put(step.target, np.frombuffer(out, np.uint8).reshape(-1, BLOCK))

    def do_imgdiff(self, step: Step) -> None:
        raise FormatError("imgdiff is not supported")


def run_all(rows: list[tuple[int, str, list[str]]], image: bytes, new: bytes, patch: bytes, expected: int | None = None, verify: bool = True) -> bytes:
    """The new image, of the expected size in bytes; without one, of the base's or up to the last block written."""
    steps = [step_of([command, *tokens]) for _, command, tokens in sorted(rows, key=lambda r: r[0])]
    wrong = unsound(steps, len(new), len(patch))
    need(wrong is None, wrong or "")
    end = max((int(s.target.max(initial=-1)) + 1 for s in steps if s.writes()), default=0)
    need(expected is None or expected >= end * BLOCK, "commands write behind the image")
    store = Store(image, new, patch, end, verify)
    for step in steps:
        store.run(step)
    want = max(len(image), end * BLOCK) if expected is None else expected
    return store.blocks.tobytes()[:want].ljust(want, b"\0")


def apply(list_commands: DataFrame, data: DataFrame, *, verify: bool = True) -> DataFrame:
    """(partition, content): the new images. data: (partition, image, new, patch), each null if there is none, and optionally
    size: the image's declared size in bytes; several rows of a partition count together. Other columns of data come behind.
    Commands and data are dealt together, without a join."""
    fields_ = [f for f in data.schema if f.name != "partition"]
    more = [f for f in fields_ if f.name not in ("image", "new", "patch", "size")]
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields_]
    heads = data.select("partition", F.lit(-1).alias("seq"), F.lit(None).cast("string").alias("command"), F.lit(None).cast("array<string>").alias("tokens"), *[f.name for f in fields_])
    both = heads.unionByName(list_commands.select("partition", "seq", "command", "tokens", *none))
    names = [f.name for f in fields_]

    def run(key, found):
        have, rows, heads = {}, [], 0
        for _, seq, command, tokens, *values in found:
            if seq < 0:
                heads += 1
                have |= {n: v for n, v in zip(names, values, strict=True) if v is not None}
            else:
                rows.append((seq, command, tokens))
        if rows and heads:
            out = run_all(rows, *(have.get(c, b"") for c in ("image", "new", "patch")), expected=have.get("size"), verify=verify)
            yield *key, out, *(have.get(f.name) for f in more)

    schema = "partition string, content binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in more)
    return batches.grouped(both, ["partition"], ["seq"], run, schema)
