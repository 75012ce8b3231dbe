"""Events, aggregates and profiles as text: lines, messages, memories, reports and prompts.

A template names columns in braces; ``rendered`` compiles a table of templates
by event type into one CASE expression, so that rendering is a projection.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.paths import anonymised, basename
from tracewell.sources.traces import KEY

PATHS = ("file_path", "directory_path", "dir_path", "old_path", "new_path", "source_path", "dest_path", "from_file", "to_file", "source_file", "target_file")
NUMBERS = ("content_length", "lines_added", "lines_deleted", "files_matched", "files_listed", "depth", "total_files", "max_depth")

# Formats.
NARRATIVE = {
    "file_read": "Read file: {file_path} (lines {view_range}, view #{view_count}, {content_length} chars)",
    "file_write": "{operation_title} file: {file_path} ({content_length} chars)",
    "file_edit": "Edit file: {file_path} (+{lines_added}/-{lines_deleted} lines, tool: {edit_tool})",
    "file_search": "Search ({search_type}): query='{query}', {files_matched} matches",
    "file_browse": "Browse directory: {directory_path} ({files_listed} files, depth={depth})",
    "file_rename": "Rename: {old_path} -> {new_path}",
    "file_move": "Move: {old_path} -> {new_path}",
    "dir_create": "Create directory: {dir_path} (depth={depth})",
    "file_delete": "Delete file: {file_path}",
    "file_copy": "Copy: {source_path} -> {dest_path} (backup={is_backup})",
    "fs_snapshot": "FS Snapshot: {total_files} files, max_depth={max_depth}, types={file_count_by_type}",
    "context_switch": "Context switch: {from_file} -> {to_file} (trigger: {trigger})",
    "cross_file_reference": "Cross-file ref: {source_file} -> {target_file} ({reference_type})",
    "error_encounter": "Error: {error_type} - {context}",
    "error_response": "Error recovery: strategy={strategy}, success={resolution_successful}",
}
MESSAGES = {
    "file_read": ("user", "I'm reading {file_path} (view #{view_count}, {content_length} chars, lines {view_range})"),
    "file_write": ("assistant", "I {operation}d the file {file_path} ({content_length} chars)"),
    "file_edit": ("assistant", "I edited {file_path} (+{lines_added}/-{lines_deleted} lines)"),
    "file_search": ("user", "Search ({search_type}): '{query}' -> {files_matched} matches"),
    "file_browse": ("user", "Browsing directory {directory_path} ({files_listed} files)"),
    "dir_create": ("assistant", "Created directory {dir_path} (depth={depth})"),
    "file_rename": ("assistant", "Renamed {old_path} -> {new_path}"),
    "file_move": ("assistant", "Moved {old_path} -> {new_path}"),
    "file_copy": ("assistant", "Copied {source_path} -> {dest_path} (backup={is_backup})"),
    "file_delete": ("assistant", "Deleted {file_path}"),
}
CELLS = {
    "file_read": ("episodic", "Read {file_path} (view #{view_count}, {content_length} chars)"),
    "file_write": ("semantic", "{operation_title} {file_path} ({content_length} chars)"),
    "file_edit": ("semantic", "Edit {file_path} (+{lines_added}/-{lines_deleted})"),
    "dir_create": ("procedural", "Create dir {dir_path} (depth={depth})"),
    "file_move": ("procedural", "Move: {old_path} -> {new_path}"),
    "file_rename": ("procedural", "Rename: {old_path} -> {new_path}"),
    "file_copy": ("procedural", "Copy: {source_path} -> {dest_path} (backup={is_backup})"),
    "file_delete": ("procedural", "Delete file: {file_path}"),
    "file_browse": ("episodic", "Browse {directory_path} ({files_listed} files)"),
    "file_search": ("episodic", "Search ({search_type}) '{query}' -> {files_matched} matches"),
    "cross_file_reference": ("semantic", "Cross-ref: {source_file} -> {target_file} ({reference_type})"),
}
RESOURCES = {
    "file_read": ("access", None, "Accessed {file_path} (view #{view_count})"),
    "file_write": ("creation", 0.7, "Created/wrote {file_path} ({content_length} chars)"),
    "file_edit": ("modification", 0.6, "Modified {file_path} (+{lines_added}/-{lines_deleted})"),
    "dir_create": ("organization", 0.5, "Organized: created {dir_path} (depth={depth})"),
    "file_move": ("organization", 0.5, "Move: {old_path} -> {new_path}"),
    "file_rename": ("organization", 0.5, "Rename: {old_path} -> {new_path}"),
    "file_copy": ("versioning", 0.6, "Copied {source_path} -> {dest_path} (backup={is_backup})"),
    "file_delete": ("cleanup", 0.4, "Deleted {file_path}"),
    "file_search": ("search", 0.4, "Searched ({search_type}): '{query}' -> {files_matched} matches"),
    "file_browse": ("exploration", 0.3, "Explored {directory_path} ({files_listed} items)"),
}
FACTS = {
    "file_read": ("READ", "User READ file '{file_path}' (view #{view_count}, {content_length} chars) [task:{task_id}]"),
    "file_write": ("WROTE", "User {operation_upper} file '{file_path}' ({content_length} chars) [task:{task_id}]"),
    "file_edit": ("EDITED", "User EDITED file '{file_path}' (+{lines_added}/-{lines_deleted}) [task:{task_id}]"),
    "dir_create": ("CREATED", "User CREATED directory '{dir_path}' (depth={depth}) [task:{task_id}]"),
    "file_move": ("MOVED", "User MOVED '{old_path}' -> '{new_path}' [task:{task_id}]"),
    "file_rename": ("RENAMED", "User RENAMED '{old_path}' -> '{new_path}' [task:{task_id}]"),
    "file_copy": ("COPIED", "User COPIED '{source_path}' -> '{dest_path}' (backup={is_backup}) [task:{task_id}]"),
    "file_delete": ("DELETED", "User DELETED '{file_path}' [task:{task_id}]"),
    "cross_file_reference": ("REFERENCED", "File '{source_file}' REFERENCED '{target_file}' ({reference_type}) [task:{task_id}]"),
    "file_search": ("SEARCHED", "User SEARCHED ({search_type}): '{query}' -> {files_matched} matches [task:{task_id}]"),
}
ENTRIES = {
    "file_read": ("reading", ("read", "file_access"), "Read {file_path} (view #{view_count}, {content_length} chars)"),
    "file_write": ("writing", ("write", "production"), "{operation_title} {file_path} ({content_length} chars)"),
    "file_edit": ("editing", ("edit", "iteration"), "Edit {file_path} (+{lines_added}/-{lines_deleted} lines)"),
    "dir_create": ("organizing", ("directory", "organization"), "Create directory {dir_path} (depth={depth})"),
    "file_search": ("searching", ("search", "information_seeking"), "Search ({search_type}): '{query}' → {files_matched} matches"),
    "file_delete": ("organizing", ("delete", "curation"), "Delete {file_path}"),
    "file_move": ("organizing", ("move", "organization"), "file_move: {old_path} → {new_path}"),
    "file_rename": ("organizing", ("rename", "organization"), "file_rename: {old_path} → {new_path}"),
    "file_copy": ("organizing", ("copy", "organization"), "file_copy: {source_path} → {dest_path}"),
}


def _field(df: DataFrame, name: str, missing: str) -> Column:
    if name in ("operation_title", "operation_upper"):
        op = F.coalesce(F.col("operation") if "operation" in df.columns else F.lit(None), F.lit("write"))
        return F.initcap(op) if name == "operation_title" else F.upper(op)
    default = {"view_count": "1", "view_range": "[]", "is_backup": "False", "query": "", "operation": "write"}.get(name, "0" if name in NUMBERS else missing)
    if name not in df.columns:
        return F.lit(default)
    x = F.col(name)
    if name in PATHS:
        x = anonymised(x)
    elif name in ("is_backup", "resolution_successful"):
        x = F.initcap(x.cast("string"))
    elif name == "view_range":
        x = F.concat(F.lit("["), F.array_join(x.cast("array<string>"), ", "), F.lit("]"))
    return F.coalesce(x.cast("string"), F.lit(default))


def filled(df: DataFrame, template: str, missing: str = "?") -> Column:
    parts = [F.lit(p) if i % 2 == 0 else _field(df, p, missing) for i, p in enumerate(re.split(r"\{(\w+)\}", template)) if p or i % 2]
    return F.concat(*parts)


def rendered(df: DataFrame, templates: dict[str, str], missing: str = "?") -> Column:
    """The template of each row's event type, filled; null for other types."""
    out = F.lit(None).cast("string")
    for kind, template in templates.items():
        out = F.when(F.col("event_type") == kind, filled(df, template, missing)).otherwise(out)
    return out


def _by_kind(values: dict[str, str | float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("event_type")]


def truncated(text: Column, most: int, size: Column | None = None) -> Column:
    """``text`` cut to ``most`` characters with a notice of its whole length, ``size`` where ``text`` may be only its start."""
    size = F.length(text) if size is None else size
    return F.when(size > most, F.concat(F.substring(text, 1, most), F.lit("\n... [truncated, "), size.cast("string"), F.lit(" chars total]"))).otherwise(text)


def with_content(line: Column, df: DataFrame, most: int) -> Column:
    """``line`` followed by the content of writes or the diff of edits, cut to ``most`` characters (0: none, below 0: whole).

    Where ``df`` has content_chars, content is only the start of a text of that
    length, which must reach as far as ``most``.
    """
    if not most or "content" not in df.columns:
        return line
    if most < 0 and "content_chars" in df.columns:
        raise ValueError("whole contents are asked for, and the trace has only their starts")
    body = F.when(F.col("event_type") == "file_write", F.col("content"))
    change = F.coalesce(F.col("diff"), F.col("content")) if "diff" in df.columns else F.col("content")
    body = F.when(F.col("event_type") == "file_edit", change).otherwise(body)
    tag = F.when(F.col("event_type") == "file_edit", "diff").otherwise("content")
    size = F.col("content_chars") if "content_chars" in df.columns else F.length("content")
    if "diff" in df.columns:
        size = F.when(F.col("event_type") == "file_edit", F.coalesce(F.length("diff"), size)).otherwise(size)
    shown = body if most < 0 else truncated(body, most, size)
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(line, F.lit("\n--- "), tag, F.lit(" ---\n"), shown, F.lit("\n--- end ---"))).otherwise(line)


def narrative_lines(df: DataFrame, most: int = 0) -> DataFrame:
    """(keys, seq, number, line): numbered lines from 1, other types as JSON."""
    number = F.row_number().over(W.partitionBy(*KEY).orderBy("seq"))
    line = F.coalesce(rendered(df, NARRATIVE), F.concat(F.col("event_type"), F.lit(": "), F.to_json(F.struct(*(c for c in df.columns if c not in ("event_id", "timestamp", "session_id", "profile_id", "message_id", "content_chars", "content_digest"))))))
    return df.withColumn("number", number).select(*KEY, "seq", "number", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), with_content(line, df, most)).alias("line"))


def joined(lines: DataFrame, by: list[str], order: str = "seq", text: str = "line", separator: str = "\n") -> DataFrame:
    """Lines of each group in order, as one text."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return lines.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x["t"]), separator).alias("text"))


def timeline(df: DataFrame) -> DataFrame:
    """Compact lines, numbered from 0, with file names cut to 30 characters."""
    kind = F.col("event_type")
    extra = F.when(kind == "file_write", filled(df, " ({operation}, {content_length}ch)")).when(kind == "file_edit", filled(df, " (+{lines_added}/-{lines_deleted})")).when(kind == "file_read", filled(df, " ({content_length}ch)")).otherwise("")
    name = F.substring(basename(F.coalesce(F.col("file_path"), F.lit(""))), 1, 30)
    number = F.row_number().over(W.partitionBy(*KEY).orderBy("seq")) - 1
    return df.select(*KEY, "seq", F.concat(F.lit("["), number.cast("string"), F.lit("] "), kind, F.lit(" "), name, extra).alias("line"))


def messages(df: DataFrame, most: int = 1000) -> DataFrame:
    """(role, content) of ten event types."""
    text = rendered(df, {k: t for k, (_, t) in MESSAGES.items()}, "")
    return df.where(F.col("event_type").isin(*MESSAGES)).select(*KEY, "seq", _by_kind({k: r for k, (r, _) in MESSAGES.items()}).alias("role"), with_content(text, df, most).alias("content"))


def memory_cells(df: DataFrame, most: int = 1500) -> DataFrame:
    """(content, level); other types are dropped."""
    text = rendered(df, {k: t for k, (_, t) in CELLS.items()}, "")
    return df.where(F.col("event_type").isin(*CELLS)).select(*KEY, "seq", with_content(text, df, most).alias("content"), _by_kind({k: x for k, (x, _) in CELLS.items()}).alias("level"))


def resources(df: DataFrame, most: int = 1500) -> DataFrame:
    """(type, content, importance); of reads importance grows with the view count."""
    text = rendered(df, {k: t for k, (_, _, t) in RESOURCES.items()}, "")
    fixed = _by_kind({k: w for k, (_, w, _) in RESOURCES.items() if w is not None})
    views = F.coalesce(F.col("view_count"), F.lit(1)) if "view_count" in df.columns else F.lit(1)
    weight = F.when(F.col("event_type") == "file_read", 0.3 + 0.1 * F.least(views, F.lit(5))).otherwise(fixed)
    return df.where(F.col("event_type").isin(*RESOURCES)).select(*KEY, "seq", _by_kind({k: x for k, (x, _, _) in RESOURCES.items()}).alias("type"), with_content(text, df, most).alias("content"), weight.alias("importance"))


def graph_facts(df: DataFrame, most: int = 0) -> DataFrame:
    """(src, relation, dst, fact)."""
    text = rendered(df, {k: t for k, (_, t) in FACTS.items()}, "")
    target = F.coalesce(*(F.nullif(_field(df, c, ""), F.lit("")) for c in ("target_file", "new_path", "dest_path", "file_path", "dir_path") if c in df.columns), F.lit(""))
    source = F.when(F.col("event_type") == "cross_file_reference", _field(df, "source_file", "")).otherwise(F.lit("User"))
    return df.where(F.col("event_type").isin(*FACTS)).select(*KEY, "seq", source.alias("src"), _by_kind({k: r for k, (r, _) in FACTS.items()}).alias("relation"), target.alias("dst"), with_content(text, df, most).alias("fact"))


def memory_entries(df: DataFrame, confidence: float = 0.8) -> DataFrame:
    """(restatement, keywords, topic, entities, confidence)."""
    words = F.create_map(*(x for k, (_, ws, _) in ENTRIES.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))))[F.col("event_type")]
    path = F.coalesce(F.col("file_path"), F.lit(""))
    return df.where(F.col("event_type").isin(*ENTRIES)).select(
        *KEY, "seq", rendered(df, {k: t for k, (_, _, t) in ENTRIES.items()}).alias("restatement"), words.alias("keywords"), _by_kind({k: x for k, (x, _, _) in ENTRIES.items()}).alias("topic"),
        F.when(path != "", F.array(anonymised(path))).otherwise(F.array().cast("array<string>")).alias("entities"), F.lit(confidence).alias("confidence"),
    )


def chunk_tags(chunks: DataFrame) -> DataFrame:
    """What a chunk of events (keys, chunk) is about: content before operations, then searches, then structure."""
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    text = F.coalesce(F.bool_or(F.coalesce(F.col("content"), F.lit("")) != ""), F.lit(False)) if "content" in chunks.columns else F.lit(False)
    work, search, moves = n("file_write", "file_edit") > 0, n("file_search", "file_browse") > 0, n("dir_create", "file_move", "file_rename") > 0
    tag = F.when(work & text, "content_detail").when(work, "file_operation").when(search, "search_pattern").when(moves, "structural").otherwise("file_operation")
    return chunks.groupBy(*KEY, "chunk").agg(tag.alias("source"))


def session_log(trace: DataFrame) -> DataFrame:
    """Markdown log of each session: a heading per iteration, a line per event with its time."""
    w = W.partitionBy(*KEY).orderBy("seq")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")  # so that the session's time zone has no say
    at = F.date_format(F.timestamp_add("MILLISECOND", F.col("ts_ms").cast("long"), epoch), "yyyy-MM-dd HH:mm:ss")
    starts = F.col("event_type") == "iteration_start"
    head = F.concat(F.lit("## Iteration "), F.sum(starts.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("string"))
    line = F.when(starts, head).otherwise(F.concat(F.lit("- "), at, F.lit(" "), F.coalesce(rendered(trace, NARRATIVE), F.col("event_type"))))
    return joined(trace.select(*KEY, "seq", line.alias("line")), list(KEY))


def aggregate_text(aggregates: DataFrame) -> DataFrame:
    """One line per feature: mean, spread and range; ordered by key."""
    number = lambda c: F.format_string("%.3f", F.col(c))
    line = F.concat_ws("", F.lit("- "), F.col("key"), F.lit(": mean "), number("mean"), F.when(F.col("std").isNotNull(), F.concat(F.lit(" ± "), number("std"))), F.lit(" ["), number("min"), F.lit(", "), number("max"), F.lit("]"))
    return joined(aggregates.select("profile_id", "key", line.alias("line")), ["profile_id"], "key")


def session_table(scored: DataFrame, features: DataFrame) -> DataFrame:
    """Evidence table of a profile: a line per session, deviants starred."""
    rows = scored.select(*KEY, "distance", "is_deviant").join(features, list(KEY))
    star = F.when(F.col("is_deviant"), F.lit("*")).otherwise(F.lit(""))
    line = F.format_string("| %s%s | %d reads | %d writes | %d edits | %.2f |", F.concat(F.lit("T"), F.col("task_id").cast("string")), star, F.col("total_reads").cast("long"), F.col("files_created").cast("long"), F.col("total_edits").cast("long"), F.col("distance"))
    return joined(rows.select("profile_id", "task_id", line.alias("line")), ["profile_id"], "task_id")


def profile_report(tiers: DataFrame, patterns: DataFrame, absences: DataFrame, sessions: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Procedural, semantic and episodic sections of each profile; disabled channels are neither computed nor shown."""
    dims = [c for c in tiers.columns if c != "profile_id"]
    out = tiers.select("profile_id", F.concat_ws("\n", F.lit("# Procedural"), *(F.concat(F.lit(f"- {d}: "), F.col(d)) for d in dims)).alias("procedural"))
    out = out.join(patterns.select("profile_id", F.array_join("patterns", "\n").alias("_patterns")), "profile_id", "left")
    missing = absences.groupBy("profile_id").agg(F.array_join(F.array_sort(F.collect_set("absence")), ", ").alias("_absences"))
    out = out.join(missing, "profile_id", "left").withColumn("semantic", F.concat_ws("\n", F.lit("# Semantic"), "_patterns", F.when(F.col("_absences").isNotNull(), F.concat(F.lit("Absent: "), "_absences"))))
    parts = [c for c in ("procedural", "semantic") if c not in disabled]
    if "episodic" not in disabled:
        out = out.join(sessions.select("profile_id", F.concat(F.lit("# Episodic\n"), "text").alias("episodic")), "profile_id", "left")
        parts.append("episodic")
    return out.select("profile_id", F.concat_ws("\n\n", *parts).alias("report"))


#: Lines of a session's summary: label, and parts of a label, a feature and its places.
RICH_LINES = (
    ("Reading", (("reads", "total_reads", 0), ("searches", "total_searches", 0), ("browses", "total_browses", 0), ("revisit ratio", "revisit_ratio", 3), ("switch rate", "context_switch_rate", 3))),
    ("Output", (("files", "files_created", 0), ("chars", "total_output_chars", 0), ("chars a file", "avg_output_length", 0))),
    ("Directories", (("created", "dirs_created", 0), ("depth", "max_dir_depth", 0), ("files moved", "files_moved", 0))),
    ("Edits", (("edits", "total_edits", 0), ("lines on average", "avg_lines_changed", 3), ("small ones", "small_edit_ratio", 3))),
    ("Versions", (("backups", "backup_copies", 0), ("deletes", "total_deletes", 0), ("overwrites", "total_overwrites", 0))),
    ("Other media", (("images", "image_files_created", 0), ("structured files", "structured_files_created", 0), ("table rows", "markdown_table_rows", 0))),
    ("Structure", (("headings", "heading_count", 0), ("heading depth", "heading_max_depth", 0), ("list items", "list_item_count", 0), ("prose to structure", "prose_to_structure_ratio", 3))),
)


def rich_summary(features: DataFrame, files: DataFrame | None = None, patterns: DataFrame | None = None, entries: DataFrame | None = None, most_entries: int = 15, previews: int = 3, preview: int = 150) -> DataFrame:
    """(profile_id, text): a profile's sessions one after the other, in lines of features, with what they made, and the patterns across them.

    Lines of which ``features`` has no column are left out, missing values are
    0. ``files`` (KEY, seq, file_path, preview) gives the names of created
    files and the start of the first ``previews``; ``entries`` (KEY, entries)
    what was new in the last snapshot; ``patterns`` (profile_id, patterns).
    """
    lines = [F.concat(F.lit("## Session "), F.col("task_id").cast("string"))]
    for label, parts in RICH_LINES:
        there = [(n, c, d) for n, c, d in parts if c in features.columns]
        if there:
            shown = [F.concat(F.lit(f"{n} "), F.format_string(f"%.{d}f", F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), d))) for n, c, d in there]
            lines.append(F.concat(F.lit(f"  {label}: "), F.concat_ws(", ", *shown)))
    rows = features.select(*KEY, F.concat_ws("\n", *lines).alias("_lines"))
    if files is not None:
        made = files.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("seq", basename(F.col("file_path")).alias("name"), F.trim(F.replace(F.substring("preview", 1, preview), F.lit("\n"), F.lit(" "))).alias("start")))).alias("made"))
        first = F.filter(F.slice("made", 1, previews), lambda x: F.coalesce(x["start"], F.lit("")) != "")
        named = F.concat(F.lit("  Created: "), F.array_join(F.transform("made", lambda x: x["name"]), ", "))
        starts = F.transform(first, lambda x: F.concat(F.lit("  Start of "), x["name"], F.lit(": "), x["start"], F.lit("...")))
        rows = rows.join(made.select(*KEY, F.array_join(F.concat(F.array(named), starts), "\n").alias("_files")), list(KEY), "left")
    if entries is not None:
        fresh = F.when(F.size("entries") > 0, F.concat(F.lit("  New: "), F.array_join(F.slice("entries", 1, most_entries), ", ")))
        rows = rows.join(entries.select(*KEY, fresh.alias("_new")), list(KEY), "left")
    parts = [c for c in ("_lines", "_new", "_files") if c in rows.columns]
    out = joined(rows.select("profile_id", "task_id", F.concat_ws("\n", *parts).alias("line")), ["profile_id"], "task_id", "line", "\n\n")
    if patterns is not None:
        listed = F.when(F.size("patterns") > 0, F.concat(F.lit("## Patterns across sessions\n"), F.array_join(F.transform("patterns", lambda p: F.concat(F.lit("  - "), p)), "\n")))
        out = out.join(patterns.select("profile_id", listed.alias("_patterns")), "profile_id", "left").select("profile_id", F.concat_ws("\n\n", "text", "_patterns").alias("text"))
    return out


def prompts(rows: DataFrame, keys: list[str], template: str) -> DataFrame:
    """A prompt per row from a template over its columns."""
    parts = [F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) for i, p in enumerate(re.split(r"\{(\w+)\}", template)) if p or i % 2]
    return rows.select(*keys, F.concat(*parts).alias("prompt"))


#: Display names of features.
FRIENDLY_NAMES = {
    "total_reads": "read count", "search_ratio": "search usage", "revisit_ratio": "revisit rate", "browse_ratio": "browse rate", "context_switch_rate": "context switching",
    "total_output_chars": "output volume", "avg_output_length": "output length", "files_created": "file count", "dirs_created": "dir creation", "max_dir_depth": "dir depth",
    "files_moved": "file moves", "total_edits": "edit count", "avg_lines_changed": "edit size", "heading_max_depth": "heading depth", "heading_count": "heading count",
}


def friendly(key: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in FRIENDLY_NAMES.items() for x in kv))
    return F.coalesce(names[key], F.replace(key, F.lit("_"), F.lit(" ")))
