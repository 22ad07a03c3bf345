"""Commands on a folder of documents: each changes files, keeps the old version, and brings the index up to date."""

from __future__ import annotations

import hashlib
import os
import zlib
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import kind
from ..operators import digest, embedding, graph, history, index, markdown, search
from .workspace import INCLUDE, PRUNE, normalise

MARK = ".tessera"
VERSIONS = "seq long, path string, sha string, size long, command string, created_at string"
VECTORS = "embed_sha string, model string, dim int, vec array<float>"


class Refused(Exception):
    """A command that would lose or overwrite something; the message says what."""


def find_root(start: str) -> Path:
    """The nearest folder, from start upwards, that holds a workspace."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / MARK).is_dir():
            return folder
    raise FileNotFoundError(f"no workspace in {start} or above it")


class Workspace:
    """A folder on the driver's file system, with its index, versions and vectors under ``.tessera``.

    Files are changed one at a time, on the driver; what is derived from them is DataFrame work.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 50, dim: int = embedding.DIM, embedder=None):
        self.spark, self.root, self.keep, self.dim, self.embedder = spark, find_root(root), keep, dim, embedder
        self.state = self.root / MARK

    @classmethod
    def init(cls, spark: SparkSession, root: str, **how) -> Workspace:
        """Make a folder a workspace and index what is there."""
        if (Path(root) / MARK).exists():
            raise Refused(f"{root} is a workspace already")
        (Path(root) / MARK / "objects").mkdir(parents=True)
        new = cls(spark, root, **how)
        index.save(index.build(new.contents(), "mtime"), str(new.state / "index"))
        return new

    # what is there

    def paths(self) -> list[str]:
        """Documents in order, hidden and tool folders left out."""
        found = []
        for folder, inside, names in os.walk(self.root):
            inside[:] = sorted(x for x in inside if x not in PRUNE)
            found += [Path(folder, n).relative_to(self.root).as_posix() for n in names]
        ends = tuple(g.rpartition("*")[2] for g in INCLUDE)
        return sorted(x for x in found if x.lower().endswith(ends))

    def listing(self) -> DataFrame:
        rows = [(p, (s := (self.root / p).stat()).st_size, s.st_mtime_ns) for p in self.paths()]
        return self.spark.createDataFrame(rows, "path string, size long, mtime long").filter(kind("path") == "md")

    def contents(self, paths: list[str] | None = None) -> DataFrame:
        """(path, text, mtime), read on the executors that need them."""
        listing = self.listing() if paths is None else self.listing().filter(F.col("path").isin(paths))
        root = str(self.root)

        def read(batches):
            for batch in batches:
                batch["text"] = [Path(root, p).read_bytes().decode(errors="replace") for p in batch["path"]]
                yield batch[["path", "text", "mtime"]]

        return listing.mapInPandas(read, "path string, text string, mtime long")

    def index(self) -> index.Index:
        return index.load(self.spark, str(self.state / "index"))

    def versions(self) -> DataFrame:
        return self._table("versions", VERSIONS)

    def vectors(self) -> DataFrame:
        return self._table("vectors", VECTORS)

    def _table(self, name: str, schema: str) -> DataFrame:
        where = self.state / name
        return self.spark.read.schema(schema).parquet(str(where)) if where.exists() else self.spark.createDataFrame([], schema)

    def _file(self, path: str, there: bool = True) -> tuple[str, Path]:
        path = normalise(str(self.root), path)
        if there and not (self.root / path).is_file():
            raise FileNotFoundError(path)
        return path, self.root / path

    # versions

    def _snapshot(self, path: str, command: str) -> None:
        """Keep a file's bytes as they are, unless they are its newest version."""
        raw = (self.root / path).read_bytes()
        sha = hashlib.sha256(raw).hexdigest()
        newest = history.latest(self.versions().filter(F.col("path") == path)).first()
        if newest and newest["sha"] == sha:
            return
        blob = self.state / "objects" / sha[:2] / sha[2:]
        blob.parent.mkdir(parents=True, exist_ok=True)
        blob.write_bytes(zlib.compress(raw))
        seq = (self.versions().agg(F.max("seq")).first()[0] or 0) + 1
        row = (seq, path, sha, len(raw), command, datetime.now(UTC).isoformat(timespec="seconds"))
        self.spark.createDataFrame([row], VERSIONS).coalesce(1).write.mode("append").parquet(str(self.state / "versions"))

    def _blob(self, sha: str) -> bytes:
        return zlib.decompress((self.state / "objects" / sha[:2] / sha[2:]).read_bytes())

    def _changed(self, paths: list[str], gone: list[str] = ()) -> None:
        now = self.index()
        if gone:
            now = index.remove(now, self.spark.createDataFrame([(p,) for p in gone], "path string"))
        if paths:
            now = index.upsert(now, index.build(self.contents(paths), "mtime"))
        index.save(now, str(self.state / "index"))

    def log(self, path: str | None = None, n: int = 20) -> DataFrame:
        return history.log(self.versions(), path, n)

    def undo(self, path: str) -> None:
        """Back to the newest version that differs; what is there now is kept, so a second undo takes it back."""
        path, file = self._file(path, False)
        now = hashlib.sha256(file.read_bytes()).hexdigest() if file.exists() else ""
        rows = self.versions().filter((F.col("path") == path) & (F.col("sha") != now))
        target = history.latest(rows).first()
        if target is None:
            raise LookupError(f"{path} has no earlier version")
        self._put(path, self._blob(target["sha"]), "undo")

    def restore(self, path: str, prefix: str) -> None:
        """Back to the one version whose hash starts so."""
        path, _ = self._file(path, False)
        self._put(path, self._blob(history.restore_target(self.versions(), path, prefix)), "restore")

    def collect_garbage(self) -> int:
        """Drop versions beyond ``keep`` for each path, and bytes and vectors that nothing refers to; how many files went."""
        kept = history.keep_last(self.versions(), self.keep).collect()  # the log of one folder
        alive = {r["sha"] for r in kept}
        vectors = self.vectors().join(self.index().chunks.select("embed_sha").distinct(), "embed_sha", "left_semi").collect()
        gone = [b for b in (self.state / "objects").glob("*/*") if b.parent.name + b.name not in alive]
        for rows, name, schema in ((kept, "versions", VERSIONS), (vectors, "vectors", VECTORS)):
            if (self.state / name).exists():
                self.spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(self.state / name))
        for blob in gone:
            blob.unlink()
        return len(gone)

    # changes

    def _put(self, path: str, raw: bytes, command: str) -> None:
        file = self.root / path
        if file.exists():
            self._snapshot(path, command)
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(raw)
        self._changed([path])

    def new(self, path: str, text: str = "", **defaults) -> None:
        path, file = self._file(path, False)
        if file.exists():
            raise Refused(f"{path} exists")
        self._put(path, markdown.ensure_front_matter(text, {"title": file.stem, **defaults}).encode(), "new")

    def write(self, path: str, text: str) -> None:
        """Overwrite; front matter that the old text had and the new one lacks stays."""
        path, file = self._file(path, False)
        old = markdown.front_matter(file.read_text(errors="replace").split("\n"))[0] if file.exists() else {}
        self._put(path, (markdown.ensure_front_matter(text, old) if old else text).encode(), "write")

    def append(self, path: str, text: str) -> None:
        """Add to the end, after one blank line."""
        path, file = self._file(path)
        old = file.read_text(errors="replace").rstrip("\n")
        self._put(path, (f"{old}\n\n{text}" if old else text).encode(), "append")

    def section(self, address: str) -> dict:
        """The section path#heading: its heading row; an address that fits several is refused."""
        path, anchor = markdown.split_address(address)
        path, file = self._file(path)
        rows = markdown.headings(file.read_text(errors="replace"))
        found = markdown.pick(rows, anchor or "")
        if not found:
            raise LookupError(f"{path} has no section {anchor}")
        if len(found) > 1:
            raise LookupError(f"{anchor} is in lines {', '.join(str(r['line_start']) for r in found)} of {path}")
        return {"path": path, **found[0]}

    def set(self, address: str, body: str, sha: str | None = None) -> None:
        """Replace a section's body, if its hash still starts with ``sha``."""
        section = self.section(address)
        if sha and not section["content_sha"].startswith(sha):
            raise Refused(f"{address} has changed: {section['content_sha'][:12]}")
        text = (self.root / section["path"]).read_text(errors="replace")
        self._put(section["path"], markdown.replace_section(text, section, body).encode(), "set")

    def tag(self, path: str, add: list[str] = (), drop: list[str] = ()) -> list[str]:
        path, file = self._file(path)
        text = file.read_text(errors="replace")
        values, n = markdown.front_matter(text.split("\n"))
        have = markdown.tag_list(values.get("tags"))
        tags = [t for t in dict.fromkeys([*have, *add]) if t not in drop]
        body = "\n".join(text.split("\n")[n:])
        self._put(path, (markdown.render_front_matter({**values, "tags": tags}) + body.lstrip("\n")).encode(), "tag")
        return tags

    def move(self, old: str, new: str, force: bool = False) -> int:
        """Rename a document, its history and the links to it; how many links were rewritten."""
        old, source = self._file(old)
        new, target = self._file(new, False)
        if target.is_dir():
            new, target = self._file(f"{new}/{source.name}", False)
        if old == new or (target.exists() and not force):
            raise Refused(f"{new} exists" if old != new else "source and destination are the same")
        links = graph.backlinks(self.index().links, old).collect()
        self._snapshot(old, "mv")
        if target.exists():
            self._snapshot(new, "mv")
        target.parent.mkdir(parents=True, exist_ok=True)
        source.rename(target)
        rows = [tuple(r) for r in history.rekey(self.versions(), old, new).select(*[c.split()[0] for c in VERSIONS.split(", ")]).collect()]
        self.spark.createDataFrame(rows, VERSIONS).write.mode("overwrite").parquet(str(self.state / "versions"))
        touched = {}
        for r in links:
            touched.setdefault(r["src"], []).append((r["line"], r["raw"]))
        for path, raws in touched.items():
            file = self.root / path
            text = file.read_text(errors="replace")
            self._snapshot(path, "mv")
            file.write_text(graph.rewrite_links(text, raws, new))
        self._changed([new, *touched], [old])
        return len(links)

    def remove(self, path: str, force: bool = False) -> None:
        """Delete a document; refused while others link to it."""
        path, file = self._file(path)
        graph.refuse_linked(self.index().links, path, force)
        self._snapshot(path, "rm")
        file.unlink()
        self._changed([], [path])

    def sync(self, prune: bool = True) -> dict[str, str]:
        """Index what changed in the folder; (path: status) of all but the unchanged."""
        now, plan = index.sync(self.index(), self.listing(), self.contents(), prune)
        found = {r["path"]: r["status"] for r in plan.filter("status != 'unchanged'").collect()}
        if found:
            index.save(now, str(self.state / "index"))
        return found

    # questions

    def embed(self, limit: int | None = None) -> int:
        """Vectors for the chunks that have none, up to ``limit``; how many were made."""
        need = index.dirty(self.index(), self.vectors()).withColumn("input", history.embed_input(F.col("text"), F.col("heading_path")))
        need = need.dropDuplicates(["embed_sha"]).orderBy("path", "ordinal")
        made = embedding.embed(need if limit is None else need.limit(limit), self.vectors(), self.embedder, self.dim).cache()
        n = made.count()
        if n:
            made.write.mode("append").parquet(str(self.state / "vectors"))
        made.unpersist()
        return n

    def find(self, query: str, k: int = 10, text_only: bool = False, vector_only: bool = False, folder: str | None = None, tag: str | None = None, inline: int = 256):
        """(hits, warnings): hybrid search, with vectors if there are any, after a bounded backfill."""
        if text_only and vector_only:
            raise ValueError("text_only and vector_only exclude each other")
        now, said, vector = self.index(), [], None
        if not text_only:
            try:
                self.embed(inline)
                vector = embedding.embed_query(query, self.embedder, self.dim)
            except embedding.Failed as reason:
                said.append(f"text only: {reason}")
        vectors = None if vector is None else self.vectors()
        hits = search.find_chunks(now.chunks, now.files, vectors, None if vector_only and vector is not None else query, vector, k, folder, tag)
        left = index.dirty(now, self.vectors()).count()
        if left:
            said.append(f"{left} chunks have no vector")
        stale = index.plan_sync(now, self.listing(), self.contents()).filter("status = 'changed'").join(hits.select("path"), "path", "left_semi")
        said += [f"{r['path']} has changed since it was indexed" for r in stale.select("path").distinct().collect()]
        return hits, said

    def map(self, depth: int = 1, folder: str | None = None) -> str:
        now = self.index()
        rows = digest.map_rows(now.files, now.links, now.headings, None, depth, folder)
        return digest.map_text(rows, now.files, now.links, datetime.now(UTC).isoformat(timespec="seconds"))

    def doctor(self) -> DataFrame:
        now = self.index()
        return graph.doctor(now.files, now.links, now.headings, now.chunks, self.vectors(), self.dim)
