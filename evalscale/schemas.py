"""Table schemas and keys."""

from __future__ import annotations

from pyspark.sql import types as T

#: Scalars arrive as text (a JSON number or string alike) and are cast where they are used.
_TEXT = T.StringType()


def _row(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TEXT) for n in names])


_BACKEND = T.StructType([T.StructField("finish_reason", _TEXT), T.StructField("usage", _row("completion_tokens", "total_tokens"))])
_META = T.StructType(
    [T.StructField(n, _TEXT) for n in ("dataset", "question", "gold_answer", "answer_type", "sample_seed", "backend", "nested", "nested_group_id", "nested_pool_n", "nested_greedy_n1")]
    + [T.StructField("choices", T.ArrayType(_TEXT)), T.StructField("backend_metadata", _BACKEND)]
)
CANDIDATE_JSON = T.StructType(
    [
        T.StructField(n, _TEXT)
        for n in (
            "run_id dataset example_id task source_dataset model model_size_label method prompt_style selection sample_index n reasoning_language prompt response "
            "extracted_answer token_count latency_s estimated_cost answer_type"
        ).split()
    ]
    + [T.StructField("metadata", _META)]
)
SELECTION_JSON = T.StructType(
    [
        T.StructField(n, _TEXT)
        for n in (
            "run_id dataset example_id task source_dataset model model_size_label method prompt_style selection n reasoning_language selected_sample_index "
            "selected_answer gold_answer answer_type is_correct candidate_count nested nested_group_id nested_pool_n"
        ).split()
    ]
    + [T.StructField("vote_counts", T.MapType(_TEXT, _TEXT)), T.StructField("metadata", _META)]
)
EXAMPLE_JSON = T.StructType([T.StructField(n, _TEXT) for n in ("id", "task", "question", "gold_answer", "answer_type", "source_dataset", "choices")])

CONDITION = ["dataset", "model", "method", "n"]
EXAMPLE = [*CONDITION, "example_id"]
CANDIDATE = [*EXAMPLE, "sample_index"]
LABELS = ["model_size_label", "prompt_style", "reasoning_language", "selection"]
