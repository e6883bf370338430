"""The schedule of ranking runs, country blocs, and records of what was built from what."""

from __future__ import annotations

import csv
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from quillgraph.model import MASKS, Run
from quillgraph.operators import corpus
from quillgraph.sources.folders import LOCAL, Folders, Shared, expanded

CIA, CIAA = frozenset({"CN", "IN", "US"}), frozenset({"AU", "CN", "IN", "US"})


@dataclass(frozen=True)
class Planned:
    label: str
    run: Run
    bloc: str = ""

    @property
    def name(self) -> str:
        return f"{self.run.window[0]}_{self.run.window[1]}_{self.label}"

    def path(self, folder: str, what: str, group: int) -> str:
        return f"{folder.rstrip('/')}/{what}_{group}_{self.name}"


def schedule(path: str) -> list[Planned]:
    """The runs of a CSV file but those with skip set. Absent numbers are 0; a mask outside the four known ones is an error, as is a
    prior without damping or damping without a prior."""
    out = []
    with open(path, newline="") as f:
        for line, row in enumerate(csv.DictReader(f), 2):
            whole, real = (lambda c: int((row.get(c) or "0").strip() or 0)), (lambda c: float((row.get(c) or "0").strip() or 0))
            if whole("skip"):
                continue
            mask, prior, alpha = row["m"].strip(), (row.get("mu_type") or "").strip(), real("alpha")
            if mask not in MASKS:
                raise ValueError(f"{path}, line {line}: mask {mask} is none of {', '.join(MASKS)}")
            if (alpha < 1) != bool(prior):
                raise ValueError(f"{path}, line {line}: a prior goes with alpha below 1, and alpha below 1 with a prior")
            run = Run(window=(whole("tc0"), whole("tc1")), tau_s=real("tau_s"), tau_u=real("tau_u"), mask=mask, alpha=alpha, rho=whole("rho"), omega=whole("omega"), beta=whole("beta"), epsilon=whole("epsilon"), chi=real("chi"), prior=prior or "uniform")
            out.append(Planned(row["label"].strip(), run, (row.get("bloc") or "").strip()))
    return out


def blocs(rows: Iterable[tuple[str, str]]) -> dict[str, frozenset[str]]:
    """Country codes of each bloc (bloc, code), and those of the derived blocs."""
    base: dict[str, set[str]] = {}
    for bloc, code in rows:
        if bloc and code:
            base.setdefault(bloc, set()).add(code.strip())
    both = base.get("OECD", set()) | base.get("G20", set())
    derived = {"OECDG20": both, "OECDG20-CIA": both - CIA, "CIAA": CIAA, "AU": {"AU"}}
    return {k: frozenset(v) for k, v in (base | derived).items()}


def world(fw: DataFrame) -> frozenset[str]:
    """All country codes of the corpus: some hundreds."""
    return frozenset(r[0] for r in fw.select("country_code").distinct().filter("country_code IS NOT NULL").collect())


# what was built from what


def manifest_of(output: str) -> Path:
    return Path(_note(output))


def _note(output: str) -> str:
    return f"{str(output).rstrip('/')}.built.json"


def record(output: str, inputs: Iterable[str], scripts: Iterable[str] = (), seconds: float | None = None, folders: Folders = LOCAL, **more) -> None:
    """Notes beside an output which inputs and scripts, in which state, it was built from."""
    of = lambda paths: [folders.state(p) for p in paths if folders.exists(p)]
    found = {"output": str(output), "built_at": time.time(), "seconds": seconds, "inputs": of(expanded(folders, inputs)), "scripts": of(map(str, scripts))}
    folders.write(_note(output), json.dumps(found | more, indent=2))


def stale(output: str, inputs: Iterable[str], scripts: Iterable[str] = (), folders: Folders = LOCAL) -> list[str]:
    """Why an output must be built again; empty if it stands. Without a record, times alone decide."""
    output = str(output)
    if not folders.exists(output):
        return ["output does not exist"]
    inputs, scripts, note = expanded(folders, inputs), [str(s) for s in scripts], _note(output)
    if not folders.exists(note):
        made = folders.state(output)["mtime"]
        return [f"no record, and {p} is newer" for p in [*inputs, *scripts] if folders.exists(p) and folders.state(p)["mtime"] > made]
    known = json.loads(folders.read(note))
    out = []
    for kind, paths in (("inputs", inputs), ("scripts", scripts)):
        old = {r["path"]: r for r in known.get(kind, [])}
        for p in paths:
            if not folders.exists(p):
                out.append(f"{p} is missing") if kind == "inputs" else None
            elif p not in old:
                out.append(f"{p} is not in the record")
            elif (now := folders.state(p))["mtime"] > old[p]["mtime"] + 1e-6 or any(now[k] != old[p].get(k) for k in now if k not in ("path", "mtime")):
                out.append(f"{p} changed since")
    return out


def ensure(output: str, inputs: Iterable[str], build: Callable[[], None], scripts: Iterable[str] = (), allow: Callable[[str, float | None], bool] | None = None, folders: Folders = LOCAL) -> bool:
    """Builds an output that is stale, and records it; whether it did. allow (of the output and the seconds it took last) may
    decline to rebuild one that exists."""
    if not stale(output, inputs, scripts, folders):
        return False
    if folders.exists(str(output)) and allow is not None:
        note = _note(output)
        if not allow(str(output), json.loads(folders.read(note)).get("seconds") if folders.exists(note) else None):
            return False
    began = time.time()
    build()
    record(output, inputs, scripts, time.time() - began, folders)
    return True


def status(folder: str, patterns: Iterable[str], folders: Folders = LOCAL) -> dict[str, list]:
    """fresh and stale outputs (with reasons) of all records under a folder, and unmanaged files of the patterns; links, which
    stand for other outputs, are left out."""
    out: dict[str, list] = {"fresh": [], "stale": [], "unmanaged": []}
    managed = set()
    for note in folders.below(folder, ".built.json"):
        m = json.loads(folders.read(note))
        managed.add(folders.same(m["output"]))
        why = stale(m["output"], [i["path"] for i in m["inputs"]], [s["path"] for s in m["scripts"]], folders)
        out["stale" if why else "fresh"].append((m["output"], why) if why else m["output"])
    for p in patterns:
        out["unmanaged"] += [x for x in folders.named(f"{folder.rstrip('/')}/{p}") if folders.same(x) not in managed and not folders.link(x) and not x.endswith(".built.json")]
    return out


def drop(output: str, folders: Folders = LOCAL) -> None:
    """Removes an output and its record."""
    folders.drop(str(output))
    folders.drop(_note(output))


def collect_garbage(folder: str, folders: Folders = LOCAL) -> list[str]:
    """Drops outputs whose inputs are gone or changed; which they were."""
    gone = [o for o, _ in status(folder, [], folders)["stale"]]
    for o in gone:
        drop(o, folders)
    return gone


def ensure_candidates(fw_path: str, folder: str, group_col: str, window: tuple[int, int], folders: Shared) -> tuple[str, str]:
    """Paths of the candidate tables of a window, sources' and institutions', built from the flat works where either is stale."""
    named = [f"{folder.rstrip('/')}/{side}_{group_col}_{window[0]}_{window[1]}" for side in ("s", "u")]
    for k, path in enumerate(named):
        ensure(path, [fw_path], lambda k=k, path=path: corpus.candidacy(folders.spark.read.parquet(fw_path), group_col, window)[k].write.mode("overwrite").parquet(path), folders=folders)
    return named[0], named[1]


def each(names: Iterable[str], done: Callable[[str], bool], work: Callable[[str], None]) -> dict[str, str]:
    """Works through units that are not done yet, going on after one that fails. What became of each: skipped, done, or the error."""
    out = {}
    for n in names:
        if done(n):
            out[n] = "skipped"
            continue
        try:
            work(n)
            out[n] = "done"
        except Exception as e:  # one unit's failure is reported, not hidden, and leaves the others their turn
            out[n] = f"{type(e).__name__}: {e}"
    return out
