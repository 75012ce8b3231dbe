"""Constants of the trace model, and the settings of operators."""

from __future__ import annotations

from dataclasses import dataclass

# Event types.
SIMULATION_TYPES = ("tool_call", "llm_response", "compaction_triggered", "session_start", "session_end", "iteration_start", "iteration_end", "error_encounter", "error_response", "fs_snapshot")
ACCEPTED_TYPES = ("file_read", "file_write", "file_edit", "file_search", "file_browse", "file_rename", "file_move", "dir_create", "file_delete", "file_copy", "fs_snapshot", "context_switch", "cross_file_reference", "iteration_end")
EXPLORATION_TYPES = ("file_read", "file_browse", "file_search")
PRODUCTION_TYPES = ("file_write", "file_edit")
ORGANIZATION_TYPES = ("file_move", "file_rename", "dir_create", "file_delete", "file_copy")
#: Types without a question, within one trajectory and across trajectories.
QUESTION_SKIPS = ("session_start", "session_end", "iteration_start", "iteration_end", "tool_call", "llm_response", "compaction_triggered")
CROSS_QUESTION_SKIPS = (*QUESTION_SKIPS, "fs_snapshot")

# File types.
STRUCTURED_TYPES = ("csv", "json", "xlsx", "yaml", "xml", "tsv")
STRUCTURED_OUTPUT_TYPES = ("json", "yaml", "csv", "xml")
PRIMARY_TYPES = ("md", "txt", "docx", "pdf")
IMAGE_TYPES = ("png", "jpg", "jpeg", "svg", "gif")
TEXT_TYPES = ("md", "txt", "csv", "json", "yaml", "yml", "xml", "tsv", "log", "ini", "toml", "rst")
MULTIMODAL_TYPES = ("png", "jpg", "jpeg", "gif", "svg", "pdf", "pptx", "docx", "xlsx")

# The fingerprint's features and their dimensions.
FINGERPRINT = (
    "search_ratio", "browse_ratio", "revisit_ratio", "avg_output_length", "files_created", "total_output_chars",
    "dirs_created", "max_dir_depth", "files_moved", "total_edits", "avg_lines_changed", "small_edit_ratio",
    "total_deletes", "delete_to_create_ratio", "structured_files_created", "markdown_table_rows", "image_files_created",
)
FINGERPRINT_DIMENSIONS = (*["A (Consumption)"] * 3, *["B (Production)"] * 3, *["C (Organization)"] * 3, *["D (Iteration)"] * 3, *["E (Curation)"] * 2, *["F (Cross-Modal)"] * 3)
DIMENSIONS = ("A", "B", "C", "D", "E", "F")
#: Keys whose spread over a profile's trajectories tells how steady it is.
CONSISTENCY_KEYS = ("total_reads", "revisit_ratio", "search_ratio", "total_output_chars", "avg_output_length", "files_created", "total_edits", "avg_lines_changed", "small_edit_ratio", "dirs_created", "max_dir_depth", "heading_count", "heading_max_depth", "prose_to_structure_ratio")


@dataclass(frozen=True)
class Settings:
    """Defaults of the operators."""

    deviation_threshold: float = 1.5
    top_shifted: int = 3
    cv_stable: float = 0.3
    phase_block: int = 5
    chunk_events: int = 20
    window_events: int = 30
    window_overlap: int = 3
    min_segment: int = 3
    max_segments: int = 5
    forced_split: int = 30
    chunk_chars: int = 800
    min_chunk_chars: int = 50
    max_chunks: int = 50
    prompt_chars: int = 160_000
    decay_half_life: float = 200.0
    copy_window_ms: int = 10_000
    cross_reference_ms: int = 30_000
    debounce_ms: int = 2_000
    deferred_delete_ms: int = 500
    top_chunks: int = 5
    knn: int = 5
    knn_least: float = 0.3
    dedup_overlap: float = 0.5
    consolidate_overlap: float = 0.4
    episode_similarity: float = 0.6
    leader_similarity: float = 0.7
    session_clusters: int = 3
    keep_blob_chars: int = 1 << 20


DEFAULTS = Settings()
