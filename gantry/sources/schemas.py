"""Explicit schemas of registries, events and telemetry. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _D, _S, _B, _I = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


JOB = _struct(
    job_id=_S, kind=_S, request_id=_S, model_id=_S, model_family=_S, train_type=_S, dataset_id=_S, cutoff_len=_I, gpu_count=_I, zero=_S, gc=_B, mbs=_I, target_gbs=_I, packing=_B,
    repeat=_I, warmup_steps=_I, measure_steps=_I, max_steps=_I, campaign_id=_S, hardware_id=_S, family_job_id=_S,
)
STATUS = _struct(classification=_S, started_unix=_D, finished_unix=_D, wall_seconds=_D, return_code=_I, gpu_mask=_S)
RENDERED = _struct(job=JOB, gpu_mask=_S, command=T.ArrayType(_S))
SUMMARY = _struct(measured_seconds=_D, max_allocated=_L, max_reserved=_L, measured_totals=T.MapType(_S, _L))
TOKENS = _struct(
    computed_tokens=_L, effective_tokens=_L, label_tokens=_L, logical_samples=_L, physical_batches=_L, computed_attention_token_pairs=_L, effective_attention_token_pairs=_L
)
MEMORY = _struct(allocated=_L, reserved=_L, max_allocated=_L, max_reserved=_L)
EVENT = _struct(
    event=_S, time_unix=_D, job_id=_S, execution_attempt_id=_S, rank=_I, local_rank=_I, world_size=_I, global_step=_I, step_seconds=_D, optimizer_step_seconds=_D, is_warmup=_B,
    micro_step_seconds=T.ArrayType(_D), tokens=TOKENS, memory=MEMORY, error=_S,
)
SCHEDULER = _struct(event=_S, time_unix=_D, job_id=_S, status=_S, gpu_mask=_S, return_code=_I)
CONVERSATION = _struct(messages=T.ArrayType(_struct(role=_S, content=_S)))
LENGTHS = _struct(sample_id=_S, total_tokens=_I, label_tokens=_I, turns=_I, assistant_turns=_I)
#: Columns of telemetry files: the first six always, the rest in extended files. All are read as text.
TELEMETRY = ("timestamp", "index", "memory", "utilization", "power", "clock", "temperature", "fan", "thermal_limit", "power_limit", "software_limit")
POOL_ROW = _struct(source_index=_L, instruction=_S, input=_S, output=_S, messages=T.ArrayType(_struct(role=_S, content=_S)))
POOL_INFO = _struct(id=_S, revision=_S, pool_rows=_L)
