"""The manifest of a managed log: which segments it has, in numbered generations, each sealed to the one before.

A generation is one file of JSON lines in the folder `_manifest`: a head, then what it adds, removes and marks. It is put there whole and only if no other writer took its number, so a
reader that holds a generation sees all of it or none, whatever happens to the files around it. A committer that lost its number reads what came between: what only adds
is tried again behind it; what removes or marks a segment that is gone raises Conflict. Every `CHECKPOINT` generations all segments are written once more, so that opening a log
reads one of these and the few generations behind it.

Seals: segment i of a generation (in order of sequence) has seal i = SHA-256 of seal i-1 and of what is known of the segment: records, first and last sequence,
bytes, hash of its last record (which rests on all records before it). The root is the last one's seal; a generation's seal is that of its parent, its root, and its own
lines. Whoever noted a generation's seal elsewhere can tell if a segment was replaced or cut off, or the manifest rewritten.

One row a segment goes through the driver, as with any listing of files: 64 MB each.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyarrow import fs

FOLDER, CHECKPOINT = "_manifest", 10
NO_SEAL = "0" * 64
#: What a seal rests on.
SEALED = ("records", "first_sequence", "last_sequence", "size", "last_hash")


class Conflict(RuntimeError):
    """Another commit removed or marked what this one needs."""


def store_of(path: str):
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def seal_of(before: str, entry: dict) -> str:
    return hashlib.sha256("|".join([before, *(str(entry[k]) for k in SEALED)]).encode()).hexdigest()


def _place(entry: dict) -> tuple:
    return entry["first_sequence"], entry["name"]


@dataclass
class State:
    """A generation: its segments by name, its seal, and the last epoch of each stream that wrote to the log."""

    generation: int = 0
    seal: str = NO_SEAL
    segments: dict[str, dict] = field(default_factory=dict)
    epochs: dict[str, int] = field(default_factory=dict)

    def ordered(self) -> list[dict]:
        return sorted(self.segments.values(), key=_place)

    def root(self) -> str:
        last = max(self.segments.values(), key=_place, default=None)
        return last["seal"] if last else NO_SEAL

    def last_sequence(self) -> int:
        return max((e["last_sequence"] for e in self.segments.values()), default=0)

    def apply(self, head: dict, actions: list[dict]) -> None:
        for a in actions:
            if "remove" in a:
                self.segments.pop(a["remove"])
            elif "add" in a:
                self.segments[a["add"]["name"]] = a["add"]
            else:
                self.segments[a["mark"]["name"]] = self.segments[a["mark"]["name"]] | a["mark"]
        self.generation, self.seal = head["generation"], head["seal"]
        if head.get("stream"):
            self.epochs[head["stream"]] = head["epoch"]


def _numbers(store, base: str, suffix: str) -> list[int]:
    found = store.get_file_info(fs.FileSelector(f"{base}/{FOLDER}", allow_not_found=True))
    return sorted(int(f.base_name.split(".")[0]) for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0].isdigit())


def newest(path: str) -> int | None:
    """The newest generation of a log; None of one without a manifest."""
    found = _numbers(*store_of(path), ".json")
    return found[-1] if found else None


def _lines(store, name: str) -> list[dict]:
    with store.open_input_stream(name) as handle:
        return [json.loads(line) for line in handle.read().decode().splitlines()]


def load(path: str, generation: int | None = None) -> State:
    """A generation (the newest one). Raises LookupError if there is none of the number."""
    store, base = store_of(path)
    numbers = _numbers(store, base, ".json")
    generation = numbers[-1] if generation is None and numbers else generation
    state = State()
    if generation is None:
        return state
    if generation not in numbers:
        raise LookupError(f"no generation {generation} of {path}")
    whole = [n for n in _numbers(store, base, ".checkpoint") if n <= generation]
    if whole:
        head, *rows = _lines(store, f"{base}/{FOLDER}/{whole[-1]:020d}.checkpoint")
        state = State(head["generation"], head["seal"], {r["name"]: r for r in rows}, head["epochs"])
    for n in numbers:
        if state.generation < n <= generation:
            head, *actions = _lines(store, f"{base}/{FOLDER}/{n:020d}.json")
            state.apply(head, actions)
    return state


def _generation(state: State, actions: list[dict], stream: str | None, epoch: int | None, kind: str) -> tuple[dict, list[dict]]:
    """Head and actions of the generation behind state, with seals: those of segments from the first changed one on are made anew."""
    after = State(state.generation, state.seal, dict(state.segments), {})
    after.apply({"generation": state.generation + 1, "seal": ""}, actions)
    rows, before, out = after.ordered(), NO_SEAL, []
    resealed = {a["add"]["name"] for a in actions if "add" in a}
    for row in rows:
        seal = seal_of(before, row)
        if row.get("seal") != seal and row["name"] not in resealed:
            out.append({"mark": {"name": row["name"], "seal": seal}})
        row["seal"], before = seal, seal
    actions = [{"add": after.segments[a["add"]["name"]]} if "add" in a else a for a in actions] + out
    body = hashlib.sha256(json.dumps(actions, sort_keys=True).encode()).hexdigest()
    head = {"generation": state.generation + 1, "time": time.time(), "kind": kind, "parent": state.seal, "root": before, "stream": stream, "epoch": epoch}
    return head | {"seal": head_seal(head, body)}, actions


def head_seal(head: dict, body: str) -> str:
    return hashlib.sha256("|".join(str(x) for x in (head["generation"], head["parent"], head["root"], head["stream"], head["epoch"], body)).encode()).hexdigest()


def put_if_absent(path: str, name: str, data: bytes, rename: Callable[[str, str], bool] | None = None) -> bool:
    """Puts a whole file in the manifest's folder unless there is one of the name. rename: one that fails where the target exists, of another store than this machine's."""
    store, base = store_of(path)
    store.create_dir(f"{base}/{FOLDER}", recursive=True)
    own, target = f"{base}/{FOLDER}/_{uuid.uuid4().hex}", f"{base}/{FOLDER}/{name}"
    with store.open_output_stream(own) as out:
        out.write(data)
    try:
        if isinstance(store, fs.LocalFileSystem):
            os.link(own, target)
            return True
        if rename is None:
            raise NotImplementedError(f"{path}: commits there need a rename that fails where the target exists")
        return rename(own, target)
    except FileExistsError:
        return False
    finally:
        if store.get_file_info(own).type == fs.FileType.File:
            store.delete_file(own)


def commit(path: str, actions: list[dict], base: State, stream: str | None = None, epoch: int | None = None, kind: str = "append", rename: Callable[[str, str], bool] | None = None, tries: int = 20) -> State:
    """The generation behind the newest one with actions ({"add": entry}, {"remove": name}, {"mark": {"name": ..., ...}}). base: the state that they were made from.

    An epoch of a stream that is in the log already changes nothing."""
    state = base
    for _ in range(tries):
        if stream is not None and epoch is not None and state.epochs.get(stream, -1) >= epoch:
            return state
        for a in actions:
            name = a.get("remove") or a.get("mark", {}).get("name")
            if name and state.segments.get(name, {}).get("vector", 0) != base.segments[name].get("vector"):
                raise Conflict(f"{name} was removed or marked by another commit")
        clash = {a["add"]["name"] for a in actions if "add" in a} & set(state.segments)
        if clash:
            raise Conflict(f"{sorted(clash)[0]} is in the log already")
        if kind == "append" and state is not base and actions and min(a["add"]["first_sequence"] for a in actions) <= state.last_sequence():
            raise Conflict("another commit took these sequences")
        head, sealed = _generation(state, actions, stream, epoch, kind)
        data = "\n".join(json.dumps(x, sort_keys=True) for x in (head, *sealed)).encode()
        if put_if_absent(path, f"{head['generation']:020d}.json", data, rename):
            state = State(state.generation, state.seal, dict(state.segments), dict(state.epochs))
            state.apply(head, sealed)
            if state.generation % CHECKPOINT == 0:
                whole = [{"generation": state.generation, "seal": state.seal, "epochs": state.epochs}, *state.ordered()]
                put_if_absent(path, f"{state.generation:020d}.checkpoint", "\n".join(json.dumps(x, sort_keys=True) for x in whole).encode(), rename)
            return state
        state = load(path)
    raise Conflict(f"{path}: other commits were first {tries} times")


def appended(path: str, after: int, until: int) -> list[dict]:
    """What generations behind `after`, up to `until`, appended (not what they rewrote)."""
    store, base = store_of(path)
    out = []
    for n in _numbers(store, base, ".json"):
        if after < n <= until:
            head, *actions = _lines(store, f"{base}/{FOLDER}/{n:020d}.json")
            out += [a["add"] for a in actions if "add" in a and head["kind"] == "append"]
    return out


def history(path: str, generation: int | None = None) -> list[dict]:
    """Heads of all generations up to one, with valid: whether each follows from its parent and its own lines."""
    store, base = store_of(path)
    out, parent = [], NO_SEAL
    for expected, n in enumerate((n for n in _numbers(store, base, ".json") if generation is None or n <= generation), 1):
        head, *actions = _lines(store, f"{base}/{FOLDER}/{n:020d}.json")
        body = hashlib.sha256(json.dumps(actions, sort_keys=True).encode()).hexdigest()
        out.append(head | {"valid": n == expected == head["generation"] and head["parent"] == parent and head["seal"] == head_seal(head, body)})
        parent = head["seal"]
    return out
