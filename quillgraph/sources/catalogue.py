"""Tables in a shared folder that applications find again by what they were made from, and drop when none uses them."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.sources.folders import Shared, expanded


class Catalogue:
    """Entries of a folder on the shared file system. An entry is a folder named by an operator and a fingerprint of its parameters
    and input files. In it lie

    * data folders, each written by one builder under a name of its own, so builders at the same time do not meet;
    * a note for each data folder, written when that is whole: the oldest note names the table;
    * a use for each holder, which is how references are counted: no counter that two applications write.

    A use that was not renewed within the lease is that of an application which died."""

    def __init__(self, spark: SparkSession, folder: str, lease: float = 86_400.0):
        self.spark, self.folder, self.lease = spark, folder.rstrip("/"), lease
        self.files = Shared(spark)
        self._held: dict[str, str] = {}

    def fingerprint(self, operator: str, inputs: Iterable[str], parameters: dict) -> str:
        states = [self.files.state(p) for p in sorted(expanded(self.files, inputs))]
        said = json.dumps([operator, parameters, states], sort_keys=True, default=repr)
        return hashlib.sha256(said.encode()).hexdigest()[:32]

    def table(self, operator: str, inputs: Iterable[str], make: Callable[[], DataFrame], **parameters) -> DataFrame:
        """make's table, read where an entry has it, else built. Changed parameters or input files make another entry. The table is
        held until it is released."""
        entry = f"{self.folder}/{operator}-{self.fingerprint(operator, inputs, parameters)}"
        self.renew(entry)  # before the look: a table seen after this is one that nobody drops
        notes = self._notes(entry)
        if not notes:
            self._build(entry, operator, make())
            notes = self._notes(entry)
        return self.spark.read.parquet(f"{entry}/{notes[0]['data']}")

    def _build(self, entry: str, operator: str, df: DataFrame) -> None:
        name, began = uuid.uuid4().hex, time.time()
        df.write.parquet(f"{entry}/data-{name}")
        note = {"operator": operator, "data": f"data-{name}", "built_at": time.time(), "seconds": time.time() - began, "by": self.spark.sparkContext.applicationId}
        self.files.write(f"{entry}/note-{name}.json", json.dumps(note))

    def _notes(self, entry: str) -> list[dict]:
        found = [json.loads(self.files.read(p)) for p in self.files.named(f"{entry}/note-*.json")]
        return sorted(found, key=lambda n: (n["built_at"], n["data"]))

    def renew(self, entry: str) -> None:
        """Writes this holder's use of an entry, anew where it has one."""
        self._held.setdefault(entry, f"{entry}/use-{uuid.uuid4().hex}")
        self.files.write(self._held[entry], self.spark.sparkContext.applicationId)

    def release(self) -> None:
        """Gives up all that this holder uses."""
        for use in self._held.values():
            self.files.drop(use)
        self._held.clear()

    def uses(self, entry: str) -> int:
        """Uses within their lease."""
        return sum(self.files.age(u) <= self.lease for u in self.files.named(f"{entry}/use-*"))

    def expire(self, age: float = 0.0) -> list[str]:
        """Drops entries without a use whose newest file is older than age; which they were. An entry loses its notes first and its data
        only if no use came meanwhile; otherwise it gets its notes back. What a builder that died left behind goes the same way."""
        gone = []
        for entry in self.files.named(f"{self.folder}/*-*"):
            if self.uses(entry) or min((self.files.age(p) for p in self.files.named(f"{entry}/*")), default=age) < age:
                continue
            notes = {p: self.files.read(p) for p in self.files.named(f"{entry}/note-*.json")}
            for p in notes:
                self.files.drop(p)
            if self.uses(entry):
                for p, text in notes.items():
                    self.files.write(p, text)
                continue
            self.files.drop(entry)
            gone.append(entry)
        return gone
