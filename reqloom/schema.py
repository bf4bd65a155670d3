"""Declared schemas. Nothing is inferred: nested nulls would change types between batches."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _B, _I, _L = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.LongType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SPAN = struct(text=_S, start=_I, end=_I)
CONDITION = struct(present=_B, EARS_pattern=_S, text=_S, start=_I, end=_I)
QUANTITY = struct(v1=_D, v2=_D, tol=_D, unit_text=_S)
ENUM = struct(members_str=T.ArrayType(_S), members_qty=T.ArrayType(QUANTITY))
REF = struct(text=_S, expected_type=_S)
VALUE = struct(kind=_S, raw_text=_S, quantity=QUANTITY, enum=ENUM, boolean=_B, ref=REF)
CONSTRAINT = struct(
    constraint_idx=_I, group=struct(group_id=_S, relation=_S), target=struct(kind=_S, ref=_S), evidence=SPAN, attribute=struct(name=_S, kind=_S),
    operator=_S, value=VALUE, depends_on=_I, qualifiers=struct(negated=_B, preferred=_B, scope_all=_B),
)
STRUCTURE = struct(subject=SPAN, modality=_S, condition=CONDITION, action=SPAN, object=SPAN)
REFERENCE = struct(ref_idx=_I, evidence=SPAN, expected_type=_S, resolves_to=_S)
NORMALIZED = struct(
    constraint_idx=_I, quantity_kind_uri=_S, best_unit_uri=_S, si_value_primary=_D, si_unit_primary=_S, si_value_secondary=_D, si_unit_secondary=_S,
    lower_bound=_D, upper_bound=_D, lower_bound_included=_B, upper_bound_included=_B,
)
REQUIREMENT = struct(req_idx=_I, structure=STRUCTURE, constraints=T.ArrayType(CONSTRAINT), references=T.ArrayType(REFERENCE), raw_text=_S, normalized_quantities=T.ArrayType(NORMALIZED))
SOURCE = struct(doc_id=_S, revision=_S, section=_S, sentence_id=_S)
RECORD = struct(idx=_L, source=SOURCE, original_text=_S, requirements=T.ArrayType(REQUIREMENT))
INPUT = struct(idx=_S, original_text=_S)
STAGE_LOG = struct(idx=_L, source_idx=_S, status=_S, reason=_S, run_id=_S, provider=_S, model=_S, method=_S, seconds=_D, record=RECORD)
TRIPLE = struct(graph_id=_L, s=_S, p=_S, o=_S, o_kind=_S, o_datatype=_S, o_lang=_S)

# The names that records use.
OPERATORS = (
    "eq",
    "neq",
    "lt",
    "le",
    "gt",
    "ge",
    "between",
    "one_of",
    "all_of",
    "has_feature",
    "type_is",
    "uses_method",
    "before",
    "after",
    "during",
    "until",
)
MODALITIES = ("shall", "must", "should", "may", "will", "is")
EARS = ("ubiquitous", "event-driven", "unwanted_behaviors", "state-driven", "optional_features")
