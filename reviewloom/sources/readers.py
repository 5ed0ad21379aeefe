"""Readers of reviews, trajectories, dictionaries, prompt templates and settings."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keywords import strip


class ReadError(ValueError):
    """A file that can't be read as asked: unknown kind, missing column, or no text in it."""


TURN = "session_id string, seq bigint, type string, timestamp string, skill_name string, messages array<struct<role:string,content:string>>, response struct<content:string,finish_reason:string,model:string,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>, elapsed_ms double"


_CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
#: An agent's turns: its answers with what the dialogue was before them, and the tools it ran.
AGENT_TURN = (
    f"session_id string, seq bigint, type string, timestamp string, messages_snapshot array<struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:{_CALLS}>>, "
    f"response struct<content:string,tool_calls:{_CALLS},finish_reason:string,model:string,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>, tool_name string, tool_call_id string, arguments string, result string, elapsed_ms double"
)
AGENT_FILE, TOOL_FILE = "agent_trajectory.jsonl", "tool_trajectory.jsonl"


def read_reviews(spark: SparkSession, path: str, column: str | None = None, field: str | None = None, must_hold: bool = True) -> DataFrame:
    """``text`` of a ``.txt`` (a review a line), ``.csv`` (``column``) or ``.json`` file (an array's ``field``); stripped, blanks dropped.

    Numbers in a JSON field are no texts and are skipped. With ``must_hold`` a file without any text is an error.
    """
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".txt":
        raw = spark.read.text(path).select(F.col("value").alias("text"))
    elif kind == ".csv":
        table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        if not column or column not in table.columns:
            raise ReadError(f"no column {column!r}; there are {', '.join(table.columns)}")
        raw = table.select(F.col(f"`{column}`").alias("text"))
    elif kind == ".json":
        if not field:
            raise ReadError("a JSON file needs a field")
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        items = whole.select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("i"))
        value = F.try_variant_get("i", f"$['{field}']", "variant")
        raw = items.where(F.schema_of_variant(value) == "STRING").select(F.try_variant_get("i", f"$['{field}']", "string").alias("text"))
    else:
        raise ReadError(f"unknown kind of file: {kind or path}")
    texts = raw.select(strip(F.col("text")).alias("text")).where(F.col("text") != "")
    if must_hold and texts.isEmpty():
        raise ReadError(f"no text in {path}")
    return texts


def read_jsonl(spark: SparkSession, path: str, schema: str = TURN) -> DataFrame:
    """Lines that are no objects are dropped. The schema is given, so nothing is inferred by an extra pass."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_sessions(spark: SparkSession, root: str, name: str = TOOL_FILE, schema: str = TURN) -> DataFrame:
    """Turns of every session below ``root``; the session is the folder's name. Turns without a number are numbered as they lie."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return rows.withColumn("session_id", F.coalesce("session_id", folder)).withColumn("seq", F.coalesce("seq", F.monotonically_increasing_id()))


def read_agent_sessions(spark: SparkSession, root: str) -> DataFrame:
    """The agent's turns of every session below ``root``; a session is known by its agent file."""
    return read_sessions(spark, root, AGENT_FILE, AGENT_TURN)


def rejected_lines(spark: SparkSession, path: str, schema: str = TURN) -> DataFrame:
    """``value`` of the lines that ``read_jsonl`` drops: neither blank nor an object of the schema."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull())


def list_sessions(turns: DataFrame) -> DataFrame:
    return turns.select("session_id").distinct().orderBy("session_id")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``word``: stripped, without blanks and lines that begin with ``#``, each once."""
    words = spark.read.text(path).select(strip(F.col("value")).alias("word"))
    return words.where((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


def profile_of(profiles: DataFrame, key: str, value: str) -> DataFrame:
    """The filter reaches the scan, and a partition where the table has one by ``key``."""
    return profiles.where(F.col(key) == value)


@dataclass(frozen=True)
class Template:
    name: str
    description: str
    system: str
    user: str
    variables: tuple[str, ...]


def parse_template(text: str, strict: bool = True) -> Template:
    """A prompt file: a head of ``key: value`` lines between dashes, then ``## system`` and ``## user`` sections.

    In ``strict`` form only these two headings part sections; otherwise every heading of one word does. Sections of one
    name are joined.
    """
    head, body = {}, text
    if m := re.match(r"\s*---\n(.*?)\n---\n?(.*)\Z", text, re.DOTALL):
        head = dict(x.split(":", 1) for x in m[1].splitlines() if ":" in x)
        body = m[2]
    heading = r"(?m)^##[ \t]+(system|user)[ \t]*$" if strict else r"(?m)^##[ \t]+(\S+)[ \t]*$"
    parts = re.split(heading, body)
    sections: dict[str, str] = {}
    for name, content in zip(parts[1::2], parts[2::2], strict=True):
        sections[name] = "\n".join(x for x in (sections.get(name), content.strip()) if x)
    found = re.findall(r"\{\{(\w+)\}\}", sections.get("system", "") + sections.get("user", ""))
    return Template(head.get("name", "").strip(), head.get("description", "").strip(), sections.get("system", ""), sections.get("user", ""), tuple(dict.fromkeys(found)))


def render(template: Template, **values: str) -> tuple[str, str]:
    """System and user text; a variable without a value is an error, an unknown value is ignored."""
    missing = [v for v in template.variables if v not in values]
    if missing:
        raise ValueError(f"missing {', '.join(missing)}")
    fill = lambda s: re.sub(r"\{\{(\w+)\}\}", lambda m: str(values.get(m[1], m[0])), s)
    return fill(template.system), fill(template.user)


def read_templates(spark: SparkSession, folder: str, strict: bool = True) -> dict[str, Template]:
    """Every ``*.md`` template of a folder, by name; a template without one is known by its file. A small fixed set, read to the driver."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    found = {}
    for row in files.orderBy("file").toLocalIterator():
        t = parse_template(row["value"], strict)
        name = t.name or re.sub(r"(?:\.skill)?\.md$", "", row["file"])
        found[name] = replace(t, name=name)
    return found


@dataclass(frozen=True)
class Settings:
    max_length: int = 512
    top_n: int = 8
    keyword_length: int = 6
    min_score: float | None = None
    latin: bool = True
    stopwords: bool = True
    contained: bool = False
    times: bool = True
    dates: bool = True
    aligned: bool = True
    threshold: float = 0.7
    rounds: int = 5
    method: str = "tfidf"
    strict: bool = False
    cache_seconds: int = 3600


#: Where a sectioned file may name a setting otherwise than by its own name: (section, key).
SECTIONED = {("preprocess", "max_length"): "max_length", ("postprocess", "top_n"): "top_n", ("postprocess", "max_length"): "keyword_length", ("postprocess", "min_score"): "min_score", ("reflection", "threshold"): "threshold", ("reflection", "rounds"): "rounds", ("fallback", "method"): "method", ("cache", "seconds"): "cache_seconds"}


def _lines_of(path: str) -> dict[str, str]:
    """``key: value`` and ``key=value`` lines; indented ones belong to the section above them, by ``SECTIONED`` or by their own name."""
    found: dict[str, str] = {}
    section = ""
    for line in open(path, encoding="utf-8"):
        m = re.match(r"(\s*)(?:export\s+)?([A-Za-z_][\w.-]*)\s*[:=]\s*(.*?)\s*$", re.sub(r"\s+#.*$", "", line))
        if not m or line.lstrip().startswith("#"):
            continue
        indent, key, value = m[1], m[2].lower(), m[3].strip("\"'")
        if not indent and not value:
            section = key
            continue
        section = section if indent else ""
        found[SECTIONED.get((section, key), key)] = value
    return found


def find_settings(start: str = ".", names: tuple[str, ...] = ("reviewloom.yaml", "reviewloom.yml", ".env")) -> str | None:
    """The first of the files in ``start`` or a folder above it."""
    here = os.path.abspath(start)
    while True:
        for name in names:
            if os.path.isfile(os.path.join(here, name)):
                return os.path.join(here, name)
        if os.path.dirname(here) == here:
            return None
        here = os.path.dirname(here)


def load_settings(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "REVIEWLOOM_") -> Settings:
    """Defaults, then a file of lines or of sections (YAML's plain form, .env), then the environment; values that don't fit are ignored."""
    found = {k.removeprefix(prefix.lower()): v for k, v in _lines_of(path).items()} if path and os.path.exists(path) else {}
    found |= {k[len(prefix) :].lower(): v for k, v in (os.environ if env is None else env).items() if k.startswith(prefix)}
    settings = Settings()
    for f in fields(Settings):
        if f.name not in found:
            continue
        old, text = getattr(settings, f.name), found[f.name]
        try:
            value = text.lower() in ("1", "true", "yes", "on") if isinstance(old, bool) else (float if old is None else type(old))(text)
        except ValueError:
            continue
        settings = replace(settings, **{f.name: value})
    return settings
