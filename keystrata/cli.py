"""Interactive shell: python -m keystrata.cli PATH"""

from __future__ import annotations

import sys
from datetime import datetime
from itertools import groupby

from pyspark.sql import SparkSession

from keystrata.functions.seed import seed_frame
from keystrata.model import DELETE, DUMP_KEY_WIDTH, HISTORY_LIMIT, KeyNotFound
from keystrata.sources.hadoop import Files
from keystrata.store import Store

HELP = """put KEY VALUE   delete KEY   get KEY   seed N
inspect [memtable | wal/N.log | sstable/L/N.sst]   dump memtable | wal/N.log | sstable/L/N.sst
flush   compact [LEVEL]   clear   help   exit"""

#: Arguments that each command takes.
ARITY = {"put": (2, 2), "delete": (1, 1), "get": (1, 1), "seed": (1, 1), "inspect": (0, 1), "dump": (1, 1), "flush": (0, 0), "compact": (0, 1), "clear": (0, 0), "help": (0, 0), "exit": (0, 0)}


class History:
    """Commands without consecutive repeats, the last thousand."""

    def __init__(self, files: Files | None = None, path: str | None = None) -> None:
        self.files, self.path = files, path
        self.lines: list[str] = files.read_text(path).splitlines() if files and files.exists(path) else []

    def add(self, line: str) -> None:
        if line and (not self.lines or self.lines[-1] != line):
            self.lines = [*self.lines, line][-HISTORY_LIMIT:]

    def last(self, n: int) -> list[str]:
        return self.lines[-n:] if n > 0 else []

    def save(self) -> None:
        if self.files:
            self.files.write_text(self.path, "".join(f"{x}\n" for x in self.lines))


def complete(store: Store, prefix: str) -> list[str]:
    """Names that inspect and dump take."""
    logs = [f"wal/{n}" for n in store.files.names(f"{store.paths.base}/wal")]
    runs = [f"sstable/{n}/{f.number}.sst" for n, files in enumerate(store.version.levels) for f in files]
    return [x for x in ["memtable", *logs, *runs] if x.startswith(prefix)]


def bind_completion(store: Store) -> None:
    """Lets the tab key complete commands and names, where the prompt has readline."""
    try:
        import readline
    except ImportError:
        return

    def offer(prefix: str, state: int) -> str | None:
        first = readline.get_begidx() == 0
        found = [v for v in sorted(ARITY) if v.startswith(prefix.lower())] if first else complete(store, prefix)
        return found[state] if state < len(found) else None

    readline.set_completer_delims(" ")
    readline.set_completer(offer)
    readline.parse_and_bind("tab: complete")


def _frame(store: Store, name: str):
    if name == "memtable":
        return store.memtable().orderBy("key")
    low = name.lower()
    if low.endswith(".log"):
        return store.wal(int(low.rpartition("/")[2][:-4])).orderBy("seq")
    if low.endswith(".sst"):
        level, number = low.split("/")[-2:]
        found = [f for f in store.version.levels[int(level)] if f.number == int(number[:-4])]
        if found:
            return store._run(int(level), found[0]).orderBy("key")
    return None


def boxes(title: str, columns: list[list[str]], width: int = 18, per_row: int = 4) -> str:
    """Boxes side by side under a title, per_row of them in a row; long lines are cut."""
    out = [title]
    for at in range(0, len(columns), per_row):
        part = columns[at : at + per_row]
        edge = " ".join("+" + "-" * width + "+" for _ in part)
        out.append(edge)
        for i in range(max(map(len, part))):
            out.append(" ".join(f"|{(c[i] if i < len(c) else '')[:width]:{width}}|" for c in part))
        out.append(edge)
    return "\n".join(out)


def overview(store: Store) -> str:
    """Memtable and log, then each level with its runs."""
    out = []
    for tier, rows in groupby(sorted(store.inspect().collect(), key=lambda r: (r.tier != "LM", r.tier, r["name"] is not None and r["name"].zfill(30))), key=lambda r: r.tier):
        rows = list(rows)
        if rows[0].status == "empty":
            out.append(f"{tier}: (empty)")
            continue
        cells = [[r["name"], "error"] if r.status == "error" else [r["name"], f"{r.entries} entries", *([_text(r.smallest), _text(r.largest)] if tier != "LM" else [])] for r in rows]
        out.append(boxes(f"{tier}: {rows[0].tier_entries} entries", cells))
    return "\n".join(out)


def _text(b) -> str:
    return bytes(b or b"").decode(errors="replace")


def dispatch(store: Store, line: str) -> str:
    """Runs one command and returns what to print."""
    words = line.split()
    if not words:
        return ""
    verb, args = words[0].lower(), words[1:]
    if verb not in ARITY:
        return f"unknown command: {verb}"
    if not ARITY[verb][0] <= len(args) <= ARITY[verb][1]:
        return f"wrong number of arguments\n{HELP}"
    if verb in ("help", "exit"):
        return HELP
    if verb == "put":
        store.put(*args)
    elif verb == "delete":
        store.delete(*args)
    elif verb == "get":
        try:
            return _text(store.get(args[0]))
        except KeyNotFound:
            return "not found"
    elif verb == "seed":
        if not args[0].isdigit() or int(args[0]) < 1:
            return "seed takes a positive number"
        path, n, began = store.paths.seed_index, int(args[0]), datetime.now()
        first = int(store.files.read_text(path)) if store.files.exists(path) else 0
        store.append(seed_frame(store.spark, first, n), "ord")
        store.files.write_text(path, str(first + n))
        return f"{26 * n} pairs, {(datetime.now() - began).total_seconds() * 1000 / (26 * n):.2f} ms each"
    elif verb == "flush":
        store.flush()
    elif verb == "compact":
        store.compact(int(args[0]) if args else 0)
    elif verb == "clear":
        store.clear()
    elif verb == "inspect" and not args:
        return overview(store)
    else:
        rows = _frame(store, args[0])
        if rows is None:
            return f"no such log or run: {args[0]}"
        if verb == "inspect":
            out = [f"{args[0]}: {rows.count()} entries"]
            if args[0].lower().endswith(".sst"):
                level, number = args[0].lower().split("/")[-2:]
                found = store.blocks(int(level), int(number[:-4])).collect()
                out += [f"{len(found)} blocks", *(f"block {b.block}: offset {b.block_offset}, first key {_text(b.first_key)}" for b in found)]
            return "\n".join(out)
        out = [f"{'OP':4}{'SEQ':>8}  {'KEY':{DUMP_KEY_WIDTH}}  VALUE"]
        out += [f"{'DEL' if r.op == DELETE else 'PUT':4}{r.seq:>8}  {_text(bytes(r.key)[:DUMP_KEY_WIDTH]):{DUMP_KEY_WIDTH}}  {_text(r.value)}" for r in rows.toLocalIterator()]
        return "\n".join([*out, f"total {len(out) - 1}"])
    return "ok"


def main(argv: list[str]) -> int:
    base = argv[0] if argv else "data/store"
    store = Store.open(SparkSession.builder.getOrCreate(), base)
    history = History(store.files, f"{store.paths.base}/.history")
    bind_completion(store)
    while True:
        try:
            line = input("> ").strip()
        except EOFError:
            break
        history.add(line)
        if line.lower() in ("exit", "quit"):
            break
        print(dispatch(store, line))
    history.save()
    store.close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
