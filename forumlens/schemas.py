"""Declared schemas of the engine's datasets (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

from forumlens.operators.extract import ANSWER, POST_META, QUESTION_INFO  # noqa: F401

_S, _I, _L, _B, _D, _TS, _DT = (T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(),
                                T.DoubleType(), T.TimestampType(), T.DateType())


def _st(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


STEP_KEYS = [("step", _S), ("step_label", _S), ("ord_key", _L)]

PAGE_RAW = _st(*STEP_KEYS, ("page_nr", _I), ("request_code", _I), ("circuit_closed", _B),
               ("err_msg", _S), ("content_raw", _S), ("modus", _S))
POST_RAW = _st(*STEP_KEYS, ("ml_tag", _I), ("post_id", _L), ("request_code", _I), ("circuit_closed", _B),
               ("err_msg", _S), ("content_raw", _S), ("modus", _S))
TOKENS = _st(*STEP_KEYS, ("post_id", _L), ("modus", _S), ("ml_tag", _I), ("tokenized_content", T.ArrayType(_S)))
BOW = _st(*STEP_KEYS, ("post_id", _L), ("modus", _S), ("ml_tag", _I), ("file_key", _S),
          ("keys", T.ArrayType(_I)), ("values", T.ArrayType(_L)), ("key_tokens", T.ArrayType(_S)))
POST_RESULTS = _st(*STEP_KEYS, ("flow_run_id", _S), ("flow_run_name", _S), ("result_class_name", _S),
                   ("exit_code", _I), ("exit_msg", _S), ("modus", _S), ("post_id", _L), ("ml_tag", _I))
TOPIC_DISTRIBUTION = _st(*STEP_KEYS, ("post_id", _L), ("for_step", _S), ("for_step_label", _S),
                         ("topic_id", _I), ("topic_weight", _D))
STEPS_OVERVIEW = _st(("flow_run_id", _S), ("step", _S), ("step_label", _S), ("started_at_timest", _TS),
                     ("finished_at_timest", _TS), ("result", _S), ("exit_code", _I), ("exit_msg", _S),
                     ("prev_step_lbls", T.ArrayType(_S)), ("modus", _S))
JOB_OVERVIEW = _st(("flow_run_id", _S), ("description", _S), ("topic", _S), ("options", _S),
                   ("started_at_timest", _TS), ("finished_at_timest", _TS), ("exit_code", _I),
                   ("exit_msg", _S), ("modus", _S))
ARTEFACTS = _st(("step", _S), ("step_label", _S), ("artefact_key", _S), ("artefact_value", _S),
                ("flow_run_id", _S))
