"""Folders of files whose names matter, read and written inside tasks.

A Spark file source lists every name on the driver, shows no directory without files, and fails as a whole where one file cannot be
read. Here each task lists the folder for itself and takes its share of the names, one at a time; what goes wrong with a file is a
column of its row.

Millions of small files take a block and a folder each. ``write_archives`` therefore puts the files of many folders into archives
beside the folders, and the readers see what is in them as if it lay below the root.

The headers of archives are written here in one form, and a header in that form is read here; ``tarfile``, which takes many times as long,
writes and reads what does not fit it.
"""

from __future__ import annotations

import errno
import hashlib
import os
import stat
import tarfile
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zlib import crc32

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "run_folder"
#: Bytes of a file that are held at once.
BLOCK = 1 << 20
#: Name and size, in files, of the archives that lie in a root; they are tar files compressed as a whole.
ARCHIVE, ARCHIVED = ".tar.zst", 4096
#: Kinds of members of an archive: a file, a folder, and a link that leads to itself and so can not be followed.
FILE, DIRECTORY, LINK = tarfile.REGTYPE, tarfile.DIRTYPE, tarfile.SYMTYPE
KINDS = {None: FILE, "file": FILE, "folder": DIRECTORY, "loop": LINK}
#: Rows of a batch of texts, which holds ``BLOCK`` bytes or one text more.
BATCH = 4096
EPOCH = datetime.fromtimestamp(0, timezone.utc)
SCHEMAS = {
    "documents": "folder string, content string, read_error string",
    "files": "folder string, path string, size bigint, sha256 string, modified_at timestamp, read_error string",
    "plain": "name string, content binary, modified_at timestamp",
}


class LocalFolder:
    """A folder that all tasks reach by the same path."""

    def __init__(self, root: str):
        self.root = root

    def names(self, below: str = "") -> Iterator[tuple[str, bool]]:
        """Names in a folder and whether each is a folder; a missing one has none."""
        try:
            with os.scandir(os.path.join(self.root, below)) as entries:
                for entry in entries:
                    yield entry.name, entry.is_dir(follow_symlinks=False)
        except FileNotFoundError:
            return

    def open(self, path: str):
        return open(os.path.join(self.root, path), "rb")

    def facts(self, path: str) -> tuple[int, float]:
        found = os.stat(os.path.join(self.root, path))
        if not stat.S_ISREG(found.st_mode):
            raise OSError(errno.EINVAL, "not a file")
        return found.st_size, found.st_mtime


class StoreFolder:
    """A folder of any file system that Arrow knows by its URI."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(root)
        self.selector, self.directory = fs.FileSelector, fs.FileType.Directory

    def names(self, below: str = "") -> Iterator[tuple[str, bool]]:
        for entry in self.system.get_file_info(self.selector(f"{self.root}/{below}".rstrip("/"), allow_not_found=True)):
            yield entry.base_name, entry.type == self.directory

    def open(self, path: str):
        return self.system.open_input_stream(f"{self.root}/{path}")

    def facts(self, path: str) -> tuple[int, float]:
        found = self.system.get_file_info(f"{self.root}/{path}")
        if found.size is None:
            raise FileNotFoundError(errno.ENOENT, path)
        return found.size, found.mtime_ns / 1e9


def is_local(root: str) -> bool:
    return "://" not in root or root.startswith("file:")


def local_path(root: str) -> str:
    """The path of a local folder, given with or without ``file:``."""
    return f"/{root[5:].lstrip('/')}" if root.startswith("file:") else root


def folder_of(root: str) -> LocalFolder | StoreFolder:
    return LocalFolder(local_path(root)) if is_local(root) else StoreFolder(root)


def _code(error: OSError) -> str:
    return errno.errorcode.get(error.errno or 0, "UNKNOWN")


def _walk(folder: LocalFolder | StoreFolder, below: str) -> Iterator[str]:
    for name, is_folder in folder.names(below):
        path = f"{below}/{name}"
        if is_folder:
            yield from _walk(folder, path)
        else:
            yield path


_OWNER, _REST, _END = b"0000644\x00" + b"0000000\x00" * 2, b"ustar\x0000" + bytes(247), bytes(tarfile.BLOCKSIZE)
_SUM = sum(_OWNER) + sum(_REST) + 8 * ord(" ")


def _header(name: bytes, size: int, modified: int, kind: bytes = FILE, link: bytes = b"") -> bytes:
    """The header of a member whose name has at most 100 bytes."""
    numbers = b"%011o\x00%011o\x00" % (size, modified)
    check = b"%06o\x00 " % (_SUM + sum(name) + sum(numbers) + kind[0] + sum(link))
    return b"".join((name.ljust(100, b"\x00"), _OWNER, numbers, check, kind, link.ljust(100, b"\x00"), _REST))


def _headers(name: str, size: int, modified: int, kind: bytes) -> bytes:
    link = name.rpartition("/")[2] if kind == LINK else ""
    if name.isascii() and len(name) <= 100 and size < 8**11:
        return _header(name.encode(), size, modified, kind, link.encode())
    member = tarfile.TarInfo(name)
    member.size, member.mtime, member.type, member.linkname = size, modified, kind, link
    return member.tobuf(tarfile.PAX_FORMAT)


class _Archive:
    """A tar file compressed as a whole, which appears under its name when it is closed."""

    def __init__(self, target: str):
        import pyarrow as pa

        self.target, self.part = target, f"{target}.part"
        self.out, self.pieces, self.bytes, self.members = pa.CompressedOutputStream(self.part, "zstd"), [], 0, 0

    def add(self, name: str, data: bytes, kind: bytes) -> None:
        self.pieces += (_headers(name, len(data), int(time.time()), kind), data, bytes(-len(data) % tarfile.BLOCKSIZE))
        self.bytes, self.members = self.bytes + len(data) + tarfile.BLOCKSIZE, self.members + 1
        if self.bytes >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        self.out.write(b"".join(self.pieces))
        self.pieces, self.bytes = [], 0

    def close(self) -> None:
        self.pieces += (_END, _END)
        self._flush()
        self.out.close()
        os.replace(self.part, self.target)


class _Stream:
    """Bytes of a stream, as many at a time as are asked for."""

    def __init__(self, plain):
        self.plain, self.held, self.at = plain, b"", 0

    def read(self, size: int) -> bytes:
        if self.at + size > len(self.held):
            parts = [self.held[self.at :]]
            missing = size - len(parts[0])
            while missing > 0 and (part := self.plain.read(max(missing, BLOCK))):
                parts.append(part)
                missing -= len(part)
            self.held, self.at = b"".join(parts), 0
        data = self.held[self.at : self.at + size]
        self.at += len(data)
        return data

    def back(self, data: bytes) -> None:
        self.held, self.at = data + self.held[self.at :], 0


class _Content:
    """The content of a member."""

    def __init__(self, stream: _Stream, size: int):
        self.stream, self.left = stream, size

    def read(self, size: int = -1) -> bytes:
        size = self.left if size < 0 else min(size, self.left)
        data = self.stream.read(size)
        if len(data) < size:
            raise tarfile.ReadError("unexpected end of data")
        self.left -= size
        return data


def _members(folder: LocalFolder | StoreFolder, name: str) -> Iterator[tuple]:
    """Name, kind, target of a link, size, time of modification and opened content of the members of an archive, one after another."""
    import pyarrow as pa

    with folder.open(name) as file, pa.CompressedInputStream(file, "zstd") as plain:
        stream = _Stream(plain)
        while (header := stream.read(tarfile.BLOCKSIZE)) and header != _END:
            own, link = header[:100].rstrip(b"\x00"), header[157:257].rstrip(b"\x00")
            try:
                size, modified, kind = int(header[124:135], 8), int(header[136:147], 8), header[156:157]
                plainly = header == _header(own, size, modified, kind, link) and kind in (FILE, DIRECTORY, LINK)
            except (ValueError, IndexError):
                plainly = False
            if not plainly:
                stream.back(header)
                yield from _other_members(stream)
                return
            content = _Content(stream, size)
            yield own.decode(), kind, link.decode(), size, modified, content
            while content.left:
                content.read(BLOCK)
            stream.read(-size % tarfile.BLOCKSIZE)


def _other_members(stream: _Stream) -> Iterator[tuple]:
    with tarfile.open(fileobj=stream, mode="r|") as archive:
        for member in archive:
            kind = FILE if member.isreg() else member.type
            yield member.name, kind, member.linkname, member.size, member.mtime, archive.extractfile(member) if kind == FILE else None
            # What was read is not kept.
            archive.members = []


def _unreadable(name: str, kind: bytes, link: str) -> str | None:
    """The code of the error that opening a member gives; none for a file."""
    if kind == FILE:
        return None
    if kind == DIRECTORY:
        return _code(IsADirectoryError(errno.EISDIR, name))
    if kind == LINK and link == name.rpartition("/")[2]:
        return _code(OSError(errno.ELOOP, name))
    raise OSError(errno.ENOTSUP, f"neither a file nor a folder nor a link to itself: {name}")


def _text_batches(rows: Iterator[tuple[str, bytes | None, str | None]]) -> Iterator:
    """The rows as Arrow batches; a byte that is no UTF-8 is replaced."""
    import pyarrow as pa

    def batch() -> pa.RecordBatch:
        own, contents, errors = zip(*taken, strict=True)
        try:
            texts = pa.array(contents, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([None if c is None else c.decode("utf-8", "replace") for c in contents], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(own, pa.string()), texts, pa.array(errors, pa.string())], names=["folder", "content", "read_error"])

    taken, held = [], 0
    for row in rows:
        taken.append(row)
        held += len(row[1] or b"")
        if len(taken) >= BATCH or held >= BLOCK:
            yield batch()
            taken, held = [], 0
    if taken:
        yield batch()


class _Share(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.what = options["path"], options.get("what", "documents")
        self.name, self.shares = options.get("name", ""), int(options.get("shares", "16"))

    def partitions(self) -> list[InputPartition]:
        return [_Share(k) for k in range(self.shares)]

    def read(self, partition: InputPartition) -> Iterator:
        folder = folder_of(self.root)
        if self.what == "plain":
            return self._plain(folder, partition.value)
        rows = self._folders(folder, partition)
        return _text_batches(rows) if self.what == "documents" else rows

    def _folders(self, folder, partition: InputPartition) -> Iterator[tuple]:
        archives = []
        for name, is_folder in folder.names():
            if not is_folder:
                if name.endswith(ARCHIVE):
                    archives.append(name)
                continue
            if self.what == "documents":
                if crc32(name.encode()) % self.shares == partition.value:
                    yield (name, *self._document(folder, f"{name}/{self.name}"))
                continue
            # The files of one folder are shared out as well, as it may hold most of them.
            for path in _walk(folder, name):
                if crc32(path.encode()) % self.shares == partition.value:
                    yield (name, path[len(name) + 1 :], *self._file(folder, path))

        for name in sorted(archives)[partition.value :: self.shares]:
            yield from self._archived(folder, name)

    def _archived(self, folder, name: str) -> Iterator[tuple]:
        """As of folders. All files of a folder lie in one archive."""
        with_file: dict[str, bool] = {}
        for path, kind, link, size, modified, file in _members(folder, name):
            own, _, below = path.partition("/")
            if not below and kind != DIRECTORY:
                continue
            if self.what == "documents":
                with_file.setdefault(own, False)
                if below == self.name:
                    with_file[own] = True
                    problem = _unreadable(path, kind, link)
                    yield own, None if problem else file.read(), problem
                continue
            if kind == DIRECTORY:
                continue
            if problem := _unreadable(path, kind, link):
                yield own, below, None, None, None, problem
                continue
            digest = hashlib.sha256()
            while block := file.read(BLOCK):
                digest.update(block)
            yield own, below, size, digest.hexdigest(), datetime.fromtimestamp(modified, timezone.utc), None
        for own, has in with_file.items():
            if not has:
                yield own, None, _code(FileNotFoundError(errno.ENOENT, self.name))

    def _plain(self, folder, share: int) -> Iterator[tuple]:
        """Files of the root itself whose name ends as asked, but for hidden and empty ones; one that cannot be read is an error."""
        archives = []
        for name, is_folder in folder.names():
            if is_folder or name.startswith((".", "_")):
                continue
            if name.endswith(ARCHIVE):
                archives.append(name)
            elif name.endswith(self.name) and crc32(name.encode()) % self.shares == share:
                size, modified = folder.facts(name)
                if size:
                    with folder.open(name) as file:
                        yield name, file.read(), EPOCH + timedelta(milliseconds=int(modified * 1000))
        for archive in sorted(archives)[share :: self.shares]:
            for name, kind, link, size, modified, file in _members(folder, archive):
                if kind != DIRECTORY and "/" not in name and name.endswith(self.name):
                    if problem := _unreadable(name, kind, link):
                        raise OSError(getattr(errno, problem), os.strerror(getattr(errno, problem)), name)
                    if size:
                        yield name, file.read(), datetime.fromtimestamp(modified, timezone.utc)

    def _document(self, folder, path: str) -> tuple[bytes | None, str | None]:
        try:
            with folder.open(path) as file:
                return file.read(), None
        except OSError as error:
            return None, _code(error)

    def _file(self, folder, path: str) -> tuple:
        digest = hashlib.sha256()
        try:
            size, modified = folder.facts(path)
            with folder.open(path) as file:
                while block := file.read(BLOCK):
                    digest.update(block)
        except OSError as error:
            return None, None, None, _code(error)
        return size, digest.hexdigest(), datetime.fromtimestamp(modified, timezone.utc), None


class RunFolder(DataSource):
    """``what=documents``: the file ``name`` of each direct subfolder, with its text or the code of the error. ``what=files``: all
    files below the direct subfolders with size and hash, read block by block. ``what=plain``: the files of the root itself whose name
    ends with ``name``. Archives in the root count as what they hold. ``shares``: how many tasks take part."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "documents")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def _read(spark: SparkSession, root: str, shares: int | None, **options: str) -> DataFrame:
    spark.dataSource.register(RunFolder)
    number = shares or max(16, spark.sparkContext.defaultParallelism)
    return spark.read.format(FORMAT).options(shares=str(number), **options).load(root)


def read_documents(spark: SparkSession, root: str, name: str, shares: int | None = None) -> DataFrame:
    """``folder``, ``content`` and ``read_error`` of ``<root>/<folder>/<name>`` for every folder, whether it has the file or not.

    No root is an empty table; a root that cannot be listed is an error. An unreadable file is a row with the code of its error.
    """
    return _read(spark, root, shares, what="documents", name=name)


def read_files(spark: SparkSession, root: str, shares: int | None = None) -> DataFrame:
    """``folder``, ``path``, ``size``, ``sha256``, ``modified_at`` and ``read_error`` of every file below every folder of a root."""
    return _read(spark, root, shares, what="files")


def read_plain(spark: SparkSession, root: str, ending: str, shares: int | None = None) -> DataFrame:
    """``name``, ``content`` (binary) and ``modified_at`` of the files of a root itself whose name ends with ``ending``."""
    return _read(spark, root, shares, what="plain", name=ending)


def write_archives(files: DataFrame, root: str) -> None:
    """As ``write_files``, with the files in archives that the readers look into: one for each ``ARCHIVED`` rows of a partition.

    A column ``kind`` tells what is no file: a ``folder``, or a ``loop``, which is a link to itself. Paths must differ, and the files of one
    folder must be next to each other in one partition; they share an archive. A task that is run again replaces the archives of its
    first run.
    """
    if not is_local(root):
        raise ValueError("files can be written below a local or mounted root only")
    base, call = local_path(root), uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        os.makedirs(base, exist_ok=True)
        archive, number, folder, total = None, 0, None, 0
        for batch in batches:
            for path, data, kind in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own, below, _ = path.partition("/")
                if archive is not None and archive.members >= ARCHIVED and not (below and own == folder):
                    archive.close()
                    archive, number = None, number + 1
                archive = archive or _Archive(os.path.join(base, f"{call}-{TaskContext.get().partitionId():06}-{number:06}{ARCHIVE}"))
                member = KINDS[kind]
                if member == FILE and data is None:
                    raise TypeError(f"a file without content: {path}")
                archive.add(path, data if member == FILE else b"", member)
                folder, total = own, total + 1
        if archive is not None:
            archive.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([total], pa.int64())})

    kind = "kind" if "kind" in files.columns else F.lit(None).cast("string")
    files.select("path", "content", kind).mapInArrow(run, "files bigint").write.format("noop").mode("overwrite").save()


def write_files(files: DataFrame, root: str) -> None:
    """Write ``content`` (text or binary) of each row as the file ``path`` below a local or mounted root, inside tasks.

    A file appears under its name when it is whole, so a task that is run again leaves what the first one did.
    """
    if not is_local(root):
        raise ValueError("files can be written below a local or mounted root only")
    base = local_path(root)

    def run(rows: Iterator) -> None:
        for row in rows:
            path = os.path.join(base, row["path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            data = row["content"]
            part = f"{path}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as file:
                file.write(data.encode() if isinstance(data, str) else bytes(data))
            os.replace(part, path)

    files.select("path", "content").foreachPartition(run)
