"""Vocabulary of the graph: kinds of nodes and edges, tiers, confidences, capabilities, identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of nodes by family.
NODE_KINDS: dict[str, tuple[str, ...]] = {
    "project-structure": tuple("project package module file import export external-module route event registration import-cycle".split()),
    "declaration": tuple(
        "scope symbol declaration function method constructor class interface type enum record parameter variable binding property constant value decorator type-parameter macro".split()
    ),
    "executable": tuple("statement expression operation identifier call construct call-value argument return return-value throw".split()),
    "value": tuple(
        "definition read write literal property-path allocation heap-object heap-location type-refinement generic-substitution call-context context-parameter context-return".split()
    ),
    "control-runtime": tuple(
        "cfg-entry cfg-block cfg-condition cfg-merge cfg-exit phi async-event dynamic-behavior function-effect module-initializer static-initializer singleton module-state unreachable-region".split()
    ),
    "security-evidence": tuple("source sink boundary guard taint-reach diagnostic source-span token".split()),
}
# The kinds of edges by family.
EDGE_KINDS: dict[str, tuple[str, ...]] = {
    "structure": tuple(
        """CONTAINS DECLARES DECLARES_MEMBER DECLARES_VALUE DECLARES_SCOPE DECLARES_SYMBOL SYMBOL_DECLARES REFERS_TO TYPE_REFERS_TO HAS_TYPE
        DEPENDS_ON RUNTIME_DEPENDS_ON RUNTIME_IMPLEMENTATION IMPLEMENTED_BY PACKAGE_CONTAINS EXPORTS RE_EXPORTS AST_CHILD EXPANDS_TO HAS_TOKEN
        NEXT_TOKEN HAS_DIAGNOSTIC HAS_PROPERTY_PATH DECORATES DECORATOR_ARGUMENT INITIALIZES_WITH CONTAINS_BODY HAS_SCOPE HAS_TYPE_PARAMETER
        OVERLOAD_OF STRUCTURALLY_COMPATIBLE_WITH HAS_SINGLETON SINGLETON_OF HAS_MODULE_STATE STATE_OF PARTICIPATES_IN_IMPORT_CYCLE""".split()
    ),
    "call": tuple(
        """INVOKES MAY_INVOKE CALLS HAS_ARGUMENT BINDS_PARAMETER ARGUMENT_BINDS_PARAMETER RETURNS_VALUE THROWS_VALUE RETURN_EVIDENCED_BY
        READS_CALLEE PASSES_CALLBACK HAS_CALL_CONTEXT CONTEXT_CALLS CONTEXTUALIZES CONTEXT_RETURNS""".split()
    ),
    "value": tuple(
        """DEFINES READS_FROM WRITES_TO WRITES_PARAMETER_PROPERTY VALUE_FLOWS_TO ALIASES ALIASES_VALUE POINTS_TO PREVIOUS_VERSION PROPERTY_READ
        READ_EVIDENCED_BY ALLOCATES CONTEXT_ALLOCATES PHI_INPUT PHI_FOR_SYMBOL BRANCH_READS_FROM BRANCH_PREVIOUS FUNCTION_VALUE NARROWS_TYPE
        REFINES_SYMBOL SUBSTITUTES_TYPE WRITES_HEAP READS_HEAP DYNAMIC_INPUT REACHING_DEF""".split()
    ),
    "control": tuple(
        """CFG_NEXT EXECUTES_BEFORE CONDITION TRUE_BRANCH FALSE_BRANCH LOOP_BACK LOOP_TRUE ITERATES EXCEPTION_BRANCH TRY_BODY RUNS_FINALLY
        MERGES_AT SHORT_CIRCUIT_LEFT SHORT_CIRCUIT_RIGHT SWITCH_CASE BREAKS_TO CONTINUES_TO PHI_AT""".split()
    ),
    "runtime-security": tuple(
        """CAPTURES MUTATES APPLIES_EFFECT REGISTERS_CALLBACK HANDLED_BY ASYNC_CONTINUES_AT SCHEDULES EMITS_EVENT TAINT_FLOWS_TO GUARDED_BY
        EVIDENCED_BY DUPLICATES SHADOWS ROUTE_HANDLED_BY ENTRY_POINT_OF OVERRIDES IMPLEMENTS_MEMBER DYNAMIC_BEHAVIOR_AT TAINT_SOURCE
        TAINT_SINK TAINT_REACHES""".split()
    ),
}
# Confidences by falling strength, and levels of capabilities by rising strength.
CONFIDENCE_RANK = ("exact", "high", "medium", "conservative", "low", "unresolved")
CAPABILITY_LEVELS = ("none", "partial", "complete")
CALLABLE_KINDS = ("function", "method", "constructor")
# Kinds of edges along which values flow, and reasons of a flow that keep a value's identity.
FLOW_EDGE_KINDS = tuple(
    """DEFINES VALUE_FLOWS_TO READS_FROM PROPERTY_READ ALIASES ALIASES_VALUE PHI_INPUT BRANCH_READS_FROM BRANCH_PREVIOUS POINTS_TO WRITES_HEAP
    READS_HEAP DYNAMIC_INPUT REACHING_DEF""".split()
)
IDENTITY_REASONS = tuple(
    """allocation initializer assignment write read read-value argument-value context-argument context-call-result return call-result
    branch-reaching-definition phi-input call-argument value-preserving-expression""".split()
)
# Edges of direct and of indirect calls, of callbacks, and kinds of call sites.
DIRECT_CALLS = ("CALLS",)
INDIRECT_CALLS = {"INVOKES": "invokes", "MAY_INVOKE": "may_invoke", "CONTEXT_CALLS": "context", "READS_CALLEE": "fn-pointer"}
CALLBACK_EDGES = ("REGISTERS_CALLBACK", "HANDLED_BY", "SCHEDULES")
CALLSITE_KINDS = ("call", "construct")
# The layer of each kind of node; a symbol stands in T3 where its scope lies in a function, else in T1.
TIERS: dict[str, tuple[str, ...]] = {
    "T0": tuple("project package module file external-module import-cycle".split()),
    "T1": tuple(
        """function method constructor class interface type enum record type-reference dispatch-member wiring-boundary dynamic-behavior singleton
        module-state module-initializer static-initializer effect-summary function-effect runtime-model-application route boundary decorator""".split()
    ),
    "T2": tuple("source sink taint-reach".split()),
    "T3": tuple(
        """statement expression identifier operation call construct argument return-value call-return cfg-node cfg-entry cfg-exit cfg-condition
        cfg-merge cfg-block unreachable-region phi exception-site catch-handler finally-block promise-rejection type-refinement
        dispatch-candidate scope""".split()
    ),
    "T4": tuple(
        """definition read write parameter property heap-object heap-location heap-access heap-effect context-heap-effect call-context
        context-return context-parameter context-receiver context-dispatch applied-effect type-parameter generic-substitution overload
        type-compatibility async-event runtime-symbol receiver-type unresolved-symbol dynamic-type-reference token source-line data-context
        source-span value variable binding call-value property-path allocation diagnostic constant literal""".split()
    ),
}
# Kinds whose nodes stay when bodies are left out.
SPINE_KINDS = tuple(
    """file module package namespace function method class interface record enum struct definition declaration variable parameter field
    property symbol binding import export type typedef call route sink external-module scope module-initializer constructor type-parameter
    macro decorator static-initializer""".split()
)


def semantic_kind() -> Column:
    """What an edge means: its semantic kind, where it has one."""
    return F.coalesce("semantic_kind", "kind")


def family(kind: Column, families: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit("unknown")
    for name, kinds in families.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def tier(kind: Column, local: Column | None = None) -> Column:
    """The layer of a node kind; ``local`` tells whether a symbol's scope lies in a function. Unknown kinds stand in the last layer."""
    out = F.when(kind == "symbol", F.when(F.coalesce(local, F.lit(False)), "T3").otherwise("T1") if local is not None else F.lit("T1"))
    for name, kinds in TIERS.items():
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise("T4")


def partition_of(kind: Column, frontend_id: Column) -> Column:
    """SEMANTIC without a frontend, else SPINE or BODY by kind."""
    return F.when(F.coalesce(frontend_id, F.lit("")) == "", "SEMANTIC").when(kind.isin(*SPINE_KINDS), "SPINE").otherwise("BODY")


def confidence_rank(confidence: Column) -> Column:
    """0 for the strongest; spellings fold, unknown ones come last."""
    out = F.lit(len(CONFIDENCE_RANK))
    for rank, name in enumerate(CONFIDENCE_RANK):
        out = F.when(F.lower(F.trim(confidence)) == name, rank).otherwise(out)
    return out


def stable_id(owner: str, namespace: Column, kind: Column, *parts: Column) -> Column:
    """``v2:owner:namespace:kind:`` and 20 digits of a hash over all of it, inside Catalyst."""
    digest = F.sha2(F.concat_ws("\x00", F.lit("v2"), F.lit(owner), namespace, kind, *parts), 256)
    return F.concat_ws(":", F.lit("v2"), F.lit(owner), namespace, kind, F.substring(digest, 1, 20))
