"""A log of sessions: which steps of a run passed, as rows that are only ever added."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STEPS = ("validate_project_profile", "load_project_context", "build_runtime_ast", "enrich_runtime_ast", "validate_ast_equivalence")
TRIGGERS, ACTIONS, OUTCOMES = ("agent", "manual", "ci"), ("read_only", "code_edit"), ("pass", "fail")
SESSION = "session_id string, trigger string, steps map<string,string>, artifacts map<string,string>, action string, files_modified array<string>, reason string, result string"


def log_session(spark: SparkSession, path: str, session_id: str, steps: dict[str, str], trigger: str = "manual", artifacts: dict[str, str] | None = None, action: str = "read_only", files_modified: tuple[str, ...] = (), reason: str = "") -> None:
    """Add one session; its result is success if no step failed.  session_id is a timestamp that the
    caller gives, so a session that is logged again is recognised as the same."""
    for value, known in ((trigger, TRIGGERS), (action, ACTIONS), *((s, STEPS) for s in steps), *((v, OUTCOMES) for v in steps.values())):
        if value not in known:
            raise ValueError(f"{value!r} is none of {known}")
    row = (session_id, trigger, steps, artifacts or {}, action, list(files_modified), reason, "failure" if "fail" in steps.values() else "success")
    spark.createDataFrame([row], SESSION).write.mode("append").parquet(path)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """All sessions, each once."""
    return spark.read.schema(SESSION).parquet(path).dropDuplicates(["session_id"])
