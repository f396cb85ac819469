"""Reading raw molecule records, archives and lists; writing and checking the parsed table."""

from __future__ import annotations

import hashlib
import tarfile
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The properties on a record's second line, in order, and the columns of the parsed table.
PROPERTIES = ["a", "b", "c", "mu", "alpha", "homo", "lumo", "gap", "r2", "zpve", "u0", "u", "h", "g", "cv"]
COLUMNS = ["id", "formula", "n_atoms", "n_heavy", "z", "r", "q", *PROPERTIES, "freqs", "smiles", "smiles_gdb", "inchi", "inchi_gdb"]


class ChecksumError(ValueError):
    """A file's size or digest is not the declared one."""


@dataclass(frozen=True)
class RawFile:
    name: str
    size: int
    md5: str


def file_digest(path: str | Path, algorithm: str = "md5") -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, algorithm).hexdigest()


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, md5, sha256) of files of ordinary size, computed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def verify(path: str | Path, raw: RawFile) -> None:
    """Size, then MD5."""
    if (size := Path(path).stat().st_size) != raw.size:
        raise ChecksumError(f"{raw.name}: {size} bytes, declared {raw.size}")
    if file_digest(path) != raw.md5:
        raise ChecksumError(f"{raw.name}: MD5 differs")


def fetch(raw: RawFile, folder: str | Path, url: str) -> Path:
    """The verified file; a file that is there is verified and never downloaded again, a new one gets its name when verified."""
    target = Path(folder) / raw.name
    if not target.exists():
        part = target.with_name(target.name + ".part")
        with urllib.request.urlopen(url) as source, part.open("wb") as sink:
            while block := source.read(1 << 20):
                sink.write(block)
        verify(part, raw)
        part.rename(target)
    verify(target, raw)
    return target


def manifest(raws: list[RawFile], folder: str | Path) -> pd.DataFrame:
    rows = [(r.name, (p := Path(folder) / r.name).stat().st_size, file_digest(p), file_digest(p, "sha256")) for r in raws]
    return pd.DataFrame(rows, columns=["file", "bytes", "md5", "sha256"])


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, text) of the files in tar archives, compressed or not.

    Only the archives' names are listed by the scan; each task opens its archive and reads it as a stream, member by member,
    so an archive of any size passes through a worker whose memory holds a few hundred members.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["path"]:
                with _opened(name) as source, tarfile.open(fileobj=source, mode="r|*") as archive:
                    found: list[tuple] = []
                    for member in archive:
                        if member.isfile():
                            found.append((name, member.name, archive.extractfile(member).read().decode("utf-8", "replace")))
                        if len(found) >= 500:
                            yield pd.DataFrame(found, columns=["archive", "member", "text"])
                            found = []
                    yield pd.DataFrame(found, columns=["archive", "member", "text"])

    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(run, "archive string, member string, text string")


def _opened(uri: str):
    """A file of the local or of a shared file system as a stream of bytes."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return open(urllib.request.url2pathname(uri[5:].removeprefix("//")), "rb")
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path)


def number(token: Column) -> Column:
    """A number that may be written with *^ for the exponent; null if it is none."""
    return F.replace(token, F.lit("*^"), F.lit("e")).try_cast("double")


def parse_records(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with `error` (null for good records) and the parsed columns, all by native expressions.

    Errors: a null or short record, a property line without 17 tokens or with a bad number, an atom line without 5 tokens or
    with a bad number, an unknown element. Line ends may be mixed; blank lines at the end do not matter.
    """
    from tessera.functions.composition import ELEMENTS, hill_formula

    lines = F.split(F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"\s+$", ""), "\n")
    base = rows.withColumn("_l", lines).withColumn("_n", F.trim(F.get("_l", F.lit(0))).try_cast("int"))
    tokens = lambda line: F.split(F.trim(line), r"\s+")
    base = base.withColumn("_p", tokens(F.get("_l", F.lit(1))))
    n = F.col("_n")
    inside = (n > 0) & (F.size("_l") >= n + 5)
    base = base.withColumn("_a", F.when(inside, F.transform(F.slice("_l", 3, F.greatest(n, F.lit(1))), tokens)))
    base = base.withColumn("_f", F.when(inside, F.transform(tokens(F.get("_l", n + 2)), number)))
    base = base.withColumn("_v", F.transform(F.slice("_p", 3, 15), number))
    atomic = F.create_map(*[F.lit(v) for s, k in ELEMENTS for v in (s, k)])
    get = lambda k: lambda t: F.get(t, F.lit(k))
    symbols = F.transform("_a", get(0))
    shaped = F.forall("_a", lambda t: F.size(t) == 5)
    numeric = F.forall("_a", lambda t: F.forall(F.slice(t, 2, 4), lambda v: number(v).isNotNull()))
    known = F.forall(symbols, lambda s: s.isin(*[s for s, _ in ELEMENTS]))
    error = (
        F.when(F.col(text).isNull() | n.isNull() | ~F.coalesce(inside, F.lit(False)), "short record")
        .when((F.size("_p") != 17) | F.get("_p", F.lit(1)).try_cast("bigint").isNull() | F.exists("_v", lambda v: v.isNull()), "bad property line")
        .when(~shaped | ~numeric, "bad atom line")
        .when(~known, "unknown element")
        .when(F.exists("_f", lambda v: v.isNull()), "bad frequency line")
    )
    names = F.transform("_a", lambda t: t)
    z = F.transform(symbols, lambda s: atomic[s].cast("tinyint"))
    last = lambda k: tokens(F.get("_l", n + 2 + k))
    parsed = base.withColumn("error", error).withColumn("_z", F.when(F.col("error").isNull(), z))
    good = lambda c: F.when(F.col("error").isNull(), c)
    out = {
        "id": good(F.get("_p", F.lit(1)).try_cast("bigint")),
        "formula": good(hill_formula(F.col("_z"))),
        "n_atoms": good(n),
        "n_heavy": good(F.size(F.filter("_z", lambda v: v > 1))),
        "z": F.col("_z"),
        "r": good(F.flatten(F.transform(names, lambda t: F.transform(F.slice(t, 2, 3), number)))),
        "q": good(F.transform(names, lambda t: number(F.get(t, F.lit(4))))),
        **{p: good(F.get("_v", F.lit(k))) for k, p in enumerate(PROPERTIES)},
        "freqs": good(F.col("_f")),
        "smiles_gdb": good(F.get(last(1), F.lit(0))),
        "smiles": good(F.get(last(1), F.lit(1))),
        "inchi_gdb": good(F.get(last(2), F.lit(0))),
        "inchi": good(F.get(last(2), F.lit(1))),
    }
    keep = [c for c in rows.columns if c not in out]
    return parsed.select(*keep, "error", *[c.alias(k) for k, c in out.items()])


def build_table(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, failures (member, error)): good records by id; also fails if the id differs from the number in the member's name."""
    parsed = parse_records(members)
    told = F.regexp_extract("member", r"(\d+)\D*$", 1).try_cast("bigint")
    error = F.coalesce("error", F.when(told.isNotNull() & (told != F.col("id")), F.lit("id differs from file number")))
    checked = parsed.withColumn("error", error)
    return checked.where("error is null").select(*COLUMNS), checked.where("error is not null").select("member", "error")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id): lines whose first token is all digits."""
    found = F.regexp_extract("value", r"^\s*(\d+)(?:\s|$)", 1)
    return spark.read.text(path).select(F.nullif(found, F.lit("")).try_cast("bigint").alias("id")).where("id is not null").distinct()


def write_table(df: DataFrame, path: str) -> None:
    """Parquet ordered by id within range partitions, so that scans of id ranges skip files."""
    df.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def table_is_current(spark: SparkSession, path: str, columns: list[str] = COLUMNS) -> bool:
    """Whether a table is there with exactly these columns; reads the schema only."""
    try:
        return set(spark.read.parquet(path).schema.fieldNames()) == set(columns)
    except Exception:
        return False


def write_features(df: DataFrame, path: str, key: str = "id") -> None:
    """A feature store: numbers as 32-bit floats, the key and other columns as they are, ordered by key."""
    narrow = [F.col(f.name).cast("float").alias(f.name) if f.dataType.typeName() in ("double", "decimal") and f.name != key else F.col(f.name) for f in df.schema.fields]
    df.select(*narrow).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


#: Numbers that a file for one reader may hold.
NPZ_CELLS = 20_000_000


def write_npz(df: DataFrame, path: str | Path, order: list[str]) -> None:
    """Measured features of one run as arrays in one file, in a stated order; refused beyond NPZ_CELLS numbers."""
    import numpy as np

    width = df.agg(F.count("*"), *[F.max(F.size(f.name)) for f in df.schema.fields if f.dataType.typeName() == "array"]).first()
    if width[0] * (len(df.columns) + sum(w or 0 for w in width[1:])) > NPZ_CELLS:
        raise ValueError("too large for one file: write Parquet instead")
    table = df.orderBy(*order).toArrow()
    arrays = {}
    for name in table.column_names:
        values = table.column(name).to_pylist()
        arrays[name] = np.array(values, dtype=float if values and isinstance(values[0], list) else None)
    np.savez(path, **arrays)


#: The parsed table's columns: what one value belongs to, its unit, what it is, and what it may be used for.
DICTIONARY = [
    ("id", "molecule", "", "number of the record", "key"),
    ("formula", "molecule", "", "element counts as text", "structure"),
    ("n_atoms", "molecule", "", "number of atoms", "structure"),
    ("n_heavy", "molecule", "", "number of atoms other than hydrogen", "structure"),
    ("z", "atom", "", "atomic number", "structure"),
    ("r", "atom", "Angstrom", "position", "structure"),
    ("q", "atom", "e", "partial charge", "computed"),
    *[(c, "molecule", "GHz", f"rotational constant {c.upper()}", "structure") for c in "abc"],
    ("mu", "molecule", "D", "size of the dipole moment", "target"),
    ("alpha", "molecule", "bohr^3", "isotropic polarizability", "computed"),
    ("homo", "molecule", "hartree", "highest occupied orbital energy", "computed"),
    ("lumo", "molecule", "hartree", "lowest unoccupied orbital energy", "computed"),
    ("gap", "molecule", "hartree", "difference of lumo and homo", "computed"),
    ("r2", "molecule", "bohr^2", "electronic spatial extent", "computed"),
    ("zpve", "molecule", "hartree", "zero point vibrational energy", "computed"),
    ("u0", "molecule", "hartree", "internal energy at 0 K", "computed"),
    ("u", "molecule", "hartree", "internal energy at 298.15 K", "computed"),
    ("h", "molecule", "hartree", "enthalpy at 298.15 K", "computed"),
    ("g", "molecule", "hartree", "free energy at 298.15 K", "computed"),
    ("cv", "molecule", "cal/(mol K)", "heat capacity at 298.15 K", "computed"),
    ("freqs", "mode", "1/cm", "harmonic frequency", "computed"),
    ("smiles", "molecule", "", "line notation of the relaxed structure", "structure"),
    ("smiles_gdb", "molecule", "", "line notation as it was proposed", "structure"),
    ("inchi", "molecule", "", "identifier of the relaxed structure", "structure"),
    ("inchi_gdb", "molecule", "", "identifier as it was proposed", "structure"),
]
#: Numbers that a record holds directly, one a molecule, but for the target.
NATURAL = ["n_atoms", "n_heavy", "n_c", "n_h", "n_n", "n_o", "n_f", *[p for p in PROPERTIES if p != "mu"]]


def data_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "column string, per string, unit string, meaning string, role string")


def natural_features(table: DataFrame) -> DataFrame:
    """(id, NATURAL): counts read off the atom list and the computed properties; a null atom list has null counts."""
    from tessera.functions.composition import ELEMENTS

    is_ = lambda k: lambda v: v == k
    counts = [F.when(F.col("z").isNotNull(), F.size(F.filter("z", is_(k)))).alias(f"n_{s.lower()}") for s, k in ELEMENTS]
    return table.select("id", "n_atoms", "n_heavy", *counts, *[p for p in PROPERTIES if p != "mu"])


def natural_role(feature: str) -> str:
    """What a natural feature may be used for: counts and rotational constants follow from the structure."""
    roles = {name: role for name, _, _, _, role in DICTIONARY}
    return "structure" if feature.startswith("n_") else roles[feature]
