"""Text back into data: model replies, shell commands, system-call logs, and diffs between versions."""

from __future__ import annotations

import difflib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.paths import basename, extension, ignored, temporary_extension
from tracewell.sources.traces import KEY


def json_text(reply: Column) -> Column:
    """The JSON object in a reply: without fences, from the first brace to the last, trailing and missing commas mended."""
    bare = F.regexp_replace(reply, r"(?s)```(?:json)?\s*|\s*```", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    body = F.when(body == "", bare).otherwise(body)
    body = F.regexp_replace(body, r",(\s*[}\]])", "$1")
    return F.regexp_replace(body, r'("|\d|\}|\]|true|false|null)(\s*\n\s*)(")', "$1,$2$3")


def parsed(reply: Column, schema: str, salvage: dict[str, str] | None = None) -> dict[str, Column]:
    """Fields of a reply by name; what the JSON doesn't give is salvaged by regular expression (one group each)."""
    struct = F.from_json(json_text(reply), schema)
    names = [c.strip().split()[0] for c in schema.split(",")]
    return {n: F.coalesce(struct[n].cast("string"), F.nullif(F.regexp_extract(reply, (salvage or {}).get(n, rf'"{n}"\s*:\s*"?([^",\}}\n]+)'), 1), F.lit(""))) for n in names}


#: Parts of a command line apart from quotes: what ends a sub-command, and single words.
_PART = r"(?:[^\"'&|;]|\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|(?<!&)&(?!&)|(?<!\|)\|(?!\|))+"
_WORD = r"(?:[^\s\"']|\"[^\"]*\"|'[^']*')+"
KEYWORDS = ("if", "then", "else", "fi", "for", "do", "done", "while", "case", "esac", "in", "true", "false", "cd", "echo", "exit")


def subcommands(command: Column) -> Column:
    """Commands between &&, || and ; outside quotes, trimmed, without empty ones."""
    return F.filter(F.transform(F.regexp_extract_all(command, F.lit(_PART), F.lit(0)), F.trim), lambda x: x != "")


def shell_events(commands: DataFrame, command: str = "command", folder: str = "/") -> DataFrame:
    """File events that ls, mv, mkdir, rm and cp stand for, one row per event; other columns are kept."""
    rows = commands.withColumn("_sub", F.explode(subcommands(F.col(command))))
    words = F.transform(F.regexp_extract_all(F.col("_sub"), F.lit(_WORD), F.lit(0)), lambda w: F.regexp_replace(w, "[\"']", ""))
    rows = rows.withColumn("_verb", F.element_at(words, 1)).withColumn("_args", F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: ~F.startswith(w, F.lit("-")) & ~w.isin(*KEYWORDS)))
    full = lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), p))
    parent = lambda p: F.regexp_extract(p, "^(.*)/[^/]*$", 1)
    two = F.size("_args") >= 2
    source, target = full(F.element_at("_args", -2)), full(F.element_at("_args", -1))
    event = lambda kind, path=None, src=None, dst=None, temp=None, backup=None: F.struct(F.lit(kind).alias("event_type") if isinstance(kind, str) else kind.alias("event_type"), *((c if c is not None else F.lit(None).cast(t)).alias(n) for n, c, t in (("file_path", path, "string"), ("source_file", src, "string"), ("target_file", dst, "string"), ("was_temporary", temp, "boolean"), ("is_backup", backup, "boolean"))))
    from tracewell.functions.paths import backup_extension

    made = (
        F.when(F.col("_verb") == "ls", F.array(event("file_browse", full(F.coalesce(F.get("_args", F.lit(0)), F.lit("."))))))
        .when((F.col("_verb") == "mv") & two, F.array(event(F.when(parent(source) == parent(target), "file_rename").otherwise("file_move"), None, source, target)))
        .when(F.col("_verb") == "mkdir", F.transform("_args", lambda p: event("dir_create", full(p))))
        .when(F.col("_verb") == "rm", F.transform("_args", lambda p: event("file_delete", full(p), None, None, temporary_extension(full(p)))))
        .when((F.col("_verb") == "cp") & two, F.array(event("file_copy", None, source, target, None, backup_extension(target))))
    )
    return rows.select(*commands.columns, F.explode(made).alias("e")).select(*commands.columns, "e.*")


#: Fixed value: a line of the system-call log.
OPEN_LINE = r"^\s*[\d:.]+\s+open\s+F=\d+\s+\(([^)]+)\)\s+(/\S+).*?\s+(\S+)\s*$"
# System daemons, makers of thumbnails and the watcher itself; parts of such names; kinds of files that programs open by themselves.
IGNORED_PROCESSES = (
    "mds", "mds_stores", "mdworker", "mdworker_shared", "fseventsd", "fseventsctl", "distnoted", "cfprefsd", "lsd", "trustd", "secinitd", "launchd", "syslogd",
    "logd", "notifyd", "watchdogd", "kernelmanagerd", "endpointsecurityd", "sandboxd", "syspolicyd", "runningboardd", "containermanagerd", "filecoordinationd",
    "com.apple.bird", "bird", "cloudd", "quicklookd", "quicklooksatellite", "qlmanage", "com.apple.quicklook.thumbnailsagent", "thumbnailextension", "thumbnailagent",
    "iconservicesagent", "finder", "python", "python3", "python3.12", "python3.11", "python3.10",
)
IGNORED_PARTS = ("quicklook", "thumbnail", "mdworker", "spotlight", "iconservices", "filecoordination")
NOISE_EXTENSIONS = ("plist", "db", "sqlite", "lock", "pid")


def opens(lines: DataFrame, line: str = "value") -> DataFrame:
    """(flags, path, process) of the lines that are opens."""
    part = lambda i: F.regexp_extract(line, OPEN_LINE, i)
    return lines.where(F.regexp_like(F.col(line), F.lit(OPEN_LINE))).withColumns({"flags": part(1), "path": part(2), "process": F.lower(F.regexp_replace(part(3), r"\.[^.]*$", ""))})


def reads_of_opens(found: DataFrame, watched: list[str], order: str, by: list[str] | None = None) -> DataFrame:
    """Opens for reading of watched, visible files by people's programs, without repeats of the last one."""
    under = F.lit(False)
    for folder in watched:
        under = under | F.startswith(F.col("path"), F.lit(folder.rstrip("/") + "/"))
    machine = F.col("process").isin(*IGNORED_PROCESSES)
    for part in IGNORED_PARTS:
        machine = machine | F.contains("process", F.lit(part))
    hidden = F.startswith(basename(F.col("path")), F.lit(".")) | F.contains(basename(F.col("path")), F.lit(".sb-"))
    noise = F.lower(extension(F.col("path"))).isin(*NOISE_EXTENSIONS)
    rows = found.where(F.contains("flags", F.lit("R")) & under & ~machine & ~hidden & ~noise)
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    return rows.withColumn("_last", F.lag("path").over(w)).where(F.col("_last").isNull() | (F.col("_last") != F.col("path"))).drop("_last")


def notified(raw: DataFrame, op: str = "op", source: str = "src", target: str = "dst", known: str = "known", hash_hit: str = "copied_from") -> DataFrame:
    """Raw notifications as events: renames within a folder, moves between folders, copies of known content, edits of known paths, creates, deletes."""
    parent = lambda c: F.regexp_extract(F.col(c), "^(.*)/[^/]*$", 1)
    kind = (
        F.when(F.col(op) == "moved", F.when(parent(source) == parent(target), "file_rename").otherwise("file_move"))
        .when(F.col(op) == "deleted", "file_delete")
        .when((F.col(op) == "created") & F.col(hash_hit).isNotNull(), "file_copy")
        .when(F.col(op).isin("created", "modified") & F.col(known), "file_edit")
        .when(F.col(op).isin("created", "modified"), "file_write")
    )
    hidden = ignored(F.coalesce(F.col(target), F.col(source)))
    return raw.where(~hidden).withColumn("event_type", kind).where(F.col("event_type").isNotNull())


#: What is known of a change; ``lines_modified_by_counts`` is the convention of logs that know added and deleted lines only.
CHANGE = "lines_added int, lines_deleted int, lines_modified int, lines_modified_by_counts int, diff string"


def diffs(versions: DataFrame, context: int = 3) -> DataFrame:
    """Changes between a path's consecutive texts (keys, seq, file_path, content): line counts of both conventions and the unified diff.

    The first version of a path is a create without diff; equal texts give null
    counts. Python is handed rows in batches of a hundred, not of ten thousand
    as with Arrow, so that a worker holds few texts whatever their number.
    """
    w = W.partitionBy(*KEY, "file_path").orderBy("seq")
    rows = versions.select(*KEY, "seq", "file_path", "content", F.lag("content").over(w).alias("before"), (F.row_number().over(w) == 1).alias("is_create"))

    def change(path: object, new: str | None, old: str | None) -> tuple:
        a, b = (old or "").splitlines(), (new or "").splitlines()
        added = deleted = modified = 0
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag == "insert":
                added += m - k
            elif tag == "delete":
                deleted += j - i
            elif tag == "replace":
                both = min(j - i, m - k)
                modified += both
                added += m - k - both
                deleted += j - i - both
        text = "\n".join(difflib.unified_diff(a, b, f"a/{path}", f"b/{path}", lineterm="", n=context))
        return added, deleted, modified, min(added + modified, deleted + modified), text

    same = F.col("is_create") | F.col("content").eqNullSafe(F.col("before"))
    made = F.udf(change, CHANGE, useArrow=False)
    # the texts of rows without a change stay in Spark
    sent = lambda c: F.when(~same, F.col(c))
    rows = rows.select(*KEY, "seq", "file_path", "is_create", same.alias("_same"), made("file_path", sent("content"), sent("before")).alias("_change"))
    return rows.select(*KEY, "seq", "file_path", "is_create", *(F.when(~F.col("_same"), F.col(f"_change.{c.split()[0]}")).alias(c.split()[0]) for c in CHANGE.split(", ")))


def placeholder(file_type: Column, content: Column, name: Column) -> Column:
    """Text as it is for kinds that are text, else a placeholder."""
    from tracewell.config import MULTIMODAL_TYPES, TEXT_TYPES

    return F.when(file_type.isin(*TEXT_TYPES), content).when(file_type.isin(*MULTIMODAL_TYPES), F.concat(F.lit("["), F.upper(file_type), F.lit(": "), basename(name), F.lit("]"))).otherwise(content)


Parser = Callable[[Column, Column], Column]
_PARSERS: dict[str, Parser] = {}


def register_parser(*kinds: str) -> Callable[[Parser], Parser]:
    """Makes an expression of (content, name) the parser of these file types; later registrations replace earlier ones."""

    def add(f: Parser) -> Parser:
        _PARSERS.update({k.lower(): f for k in kinds})
        return f

    return add


def parsed_content(file_type: Column, content: Column, name: Column) -> Column:
    """The content as the parser of its file type gives it, in any case; types without one as ``placeholder`` shows them."""
    out, kind = placeholder(file_type, content, name), F.lower(file_type)
    for f in dict.fromkeys(_PARSERS.values()):
        out = F.when(kind.isin(*(k for k, g in _PARSERS.items() if g is f)), f(content, name)).otherwise(out)
    return out
