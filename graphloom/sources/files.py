"""Configuration and small files of the driver: prompts, YAML settings, graph files by name, logs and history."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.sources import ntriples, turtle

#: Extensions of graph files, in the order in which a name without one is tried.
EXTENSIONS = (".nt", ".ttl", ".rdf", ".n3", ".jsonld")


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need the PyYAML package") from e
    return yaml


def deep_update(old: dict, new: dict) -> dict:
    """old with new's values; dicts in both are updated in turn. old is not changed."""
    out = dict(old)
    for key, value in new.items():
        held = out.get(key)
        out[key] = deep_update(held, value) if isinstance(held, dict) and isinstance(value, dict) else value
    return out


class Settings:
    """A YAML file of nested settings."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def read(self) -> dict:
        return _yaml().safe_load(self.path.read_text(encoding="utf-8")) or {} if self.path.exists() else {}

    def write(self, data: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(_yaml().safe_dump(data, allow_unicode=True, sort_keys=False), encoding="utf-8")

    def update(self, data: dict) -> dict:
        merged = deep_update(self.read(), data)
        self.write(merged)
        return merged

    def get(self, dotted: str) -> Any:
        """The value at a.b.c; {} if there is none."""
        found: Any = self.read()
        for key in dotted.split("."):
            if not isinstance(found, dict) or key not in found:
                return {}
            found = found[key]
        return found


class Prompts:
    """Prompts of a folder: a YAML file each, with system and user texts."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.y*ml"))

    def get(self, name: str) -> dict[str, str]:
        found = next((p for p in (self.folder / f"{name}.yaml", self.folder / f"{name}.yml") if p.exists()), None)
        if found is None:
            raise FileNotFoundError(f"no prompt {name} in {self.folder}")
        data = Settings(found).read()
        if missing := {"system", "user"} - data.keys():
            raise ValueError(f"prompt {name} has no {' and no '.join(sorted(missing))}")
        return data

    def filled(self, name: str, **values: str) -> dict[str, str]:
        """The texts with {{key}} and {key} replaced by values."""
        out = {}
        for role, text in self.get(name).items():
            for key, value in values.items():
                text = str(text).replace(f"{{{{{key}}}}}", value).replace(f"{{{key}}}", value)
            out[role] = text
        return out


class GraphFiles:
    """Graphs of a folder, by file name with or without extension. N-Triples and plain Turtle can be read; other syntaxes are known but not."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _paths(self) -> list[str]:
        """Names of files, listed through the file system of Spark."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = where.getFileSystem(conf)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def names(self) -> list[str]:
        return sorted({p.rsplit(".", 1)[0] for p in self._paths() if p.endswith(EXTENSIONS)})

    def get(self, name: str) -> PropertyGraph:
        held = self._paths()
        found = name if name in held else next((f"{name}{e}" for e in EXTENSIONS if f"{name}{e}" in held), None)
        if found is None:
            raise FileNotFoundError(f"no graph {name} in {self.folder}")
        reader = {".nt": ntriples, ".ttl": turtle}.get(found[found.rfind(".") :])
        if reader is None:
            raise ValueError(f"{found}: only N-Triples and Turtle can be read; convert it first")
        return reader.load(self.spark, f"{self.folder}/{found}")


def append_log(spark: SparkSession, path: str, level: str, name: str, message: str) -> None:
    row = spark.createDataFrame([(level, name, message)], "level string, name string, message string")
    row.select(F.date_format(F.current_timestamp(), "HH:mm:ss").alias("timestamp"), "*").write.mode("append").parquet(path)


def append_history(results: DataFrame, path: str, question: str) -> None:
    """results (success, answer, paths) as a row of history: timestamp, query, result (JSON)."""
    rows = results.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.lit(question).alias("query"), F.to_json(F.struct("*")).alias("result"))
    rows.write.mode("append").parquet(path)
