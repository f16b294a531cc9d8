"""Record schemas and the fixed values shared by the whole package."""

from __future__ import annotations

MESSAGE = "struct<role:string,content:string>"
MESSAGES = f"array<{MESSAGE}>"
SPARSE = "struct<indices:array<bigint>,values:array<float>>"

ACTION = "struct<action_type:string,payload:string,target_memory_id:string>"

# Score thresholds of the write and the read path, byte budgets
# of the context query and of its fallback, and the marker put before queries.
INSERT_THRESHOLD = 0.6
READ_THRESHOLD = 0.65
CONTEXT_BYTES = 500
FALLBACK_BYTES = 2000
QUERY_MARKER = "_Query_"

# Roles of a message and their transcript prefixes.
ROLE_PREFIX = {"user": "User: ", "model": "Assistant: ", "system": "System: "}
#: Extra role names read as another role; pass ``{}`` for the strict rule.
ROLE_ALIASES = {"assistant": "model"}

# Keys of a curation plan (they hold a space).
PLAN_REASONING = "step_1 critical_reasoning"
PLAN_CORE = "step_2 core_memory_actions"
PLAN_GENERAL = "step_3 general_memory_actions"

# Assumed defaults of the fused search; parameters wherever they are used.
BRANCH_LIMIT = 10
RESULT_LIMIT = 10
RRF_K = 2
RANK_BASE = 0
