"""Task datasets: windows joined to the labels of a named task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.columns import label_date, window_zscore
from pulsegrid.operators import labels as L
from pulsegrid.operators.aggregate import zscore_columns
from pulsegrid.operators.joins import lookup_labels

# Channel sets a task may ask for.
DEFAULT_FIELDS = (
    "heart_rate", "missing_heart_rate", "missing_steps", "sleep_classic_0", "sleep_classic_1",
    "sleep_classic_2", "sleep_classic_3", "steps",
)
NO_MISSING_FLAG_FIELDS = ("heart_rate", "steps", "sleep_classic_1", "sleep_classic_2", "sleep_classic_3")

Tables = Mapping[str, DataFrame]


def _clause(text: str) -> Callable[[Tables], DataFrame]:
    return lambda tables, **_: L.survey_clause(tables["surveys"], text)


# Survey clauses of the named tasks.
CLAUSES = {
    "cough": "symptom_severity__cough_q_3 > 0 | symptom_severity__cough_q_2 > 0",
    "severe_fever": "symptom_severity__fever_q_3 > 0 | symptom_severity__fever_q_2 > 0",
    "fatigue": "(symptom_severity__q_fatigue_2 > 0) | (symptom_severity__q_fatigue_3 > 0)",
    "flu_symptoms": "have_flu > 0",
    "severe_symptoms": "severity_overall_3 > 0 | severity_overall_2 > 0",
    "mobility_difficulty": "t_difficulty__q_mobility_2 > 0",
    "signals_aches": "(daily_symptoms__aches == 'moderate') | (daily_symptoms__aches == 'severe')",
    "signals_chills": "(daily_symptoms__chills == 'moderate') | (daily_symptoms__chills == 'severe')",
    "signals_cough": "(daily_symptoms__cough == 'moderate') | (daily_symptoms__cough == 'severe')",
    "signals_headache": "(daily_symptoms__headache == 'moderate') | (daily_symptoms__headache == 'severe')",
}

def _weak_flu(tables: Tables, **arguments) -> DataFrame:
    """Model-based flu probability; fits its model when called."""
    from pulsegrid.operators.mljobs import weak_flu_probability

    return weak_flu_probability(tables["surveys"], tables["labs"], tables["day_level"], **arguments)


def _daily_features(
    tables: Tables, columns: Sequence[str] = L.DAY_FEATURE_COLUMNS, days: int = 7, normalize: bool = True
) -> DataFrame:
    """Vectors of ``days`` days, values z-scored over the whole table unless told otherwise; missing flags stay."""
    table = tables["day_level"]
    if normalize:
        table = zscore_columns(table, [c for c in columns if "missing" not in c])
    return L.rolling_day_vectors(table, columns, days)


# Label builders by task name: (tables, **arguments) -> label table.
TASKS: dict[str, Callable[..., DataFrame]] = {
    "flu_positive": lambda tables, **a: L.flu_positive(tables["labs"], **a),
    "flu_positive_weak": _weak_flu,
    "lab_survey_positive": lambda tables, **a: L.lab_survey_positive(tables["labs"], tables["weekly"], **a),
    "diagnosis_date": lambda tables, **a: L.diagnosis_date(tables["diagnoses"], **a),
    "ili": lambda tables, **a: L.ili_window(tables["ili"], **a),
    "daily_features": lambda tables, **a: _daily_features(tables, **a),
    "clean_annotation": lambda tables, **a: L.clean_annotation(tables["surveys"], tables["labs"], **a),
    "survey_clause": lambda tables, **a: L.survey_clause(tables["surveys"], a["text"]),
    "weekend": lambda tables, **a: L.weekday_label(
        tables["windows"].select("participant_id", label_date("end").alias("date")).distinct(), **a
    ),
    "obesity": lambda tables, **a: L.obesity(tables["screener"], **a),
    **{name: _clause(text) for name, text in CLAUSES.items()},
}


# What a window without a row in the label table gets; 0 where a task is not listed.
DEFAULTS: dict[str, Callable[..., object]] = {
    "daily_features": lambda columns=L.DAY_FEATURE_COLUMNS, days=7, **_: L.default_day_vector(columns, days),
    "clean_annotation": lambda **_: 1,
}


def register_task(name: str, build: Callable[..., DataFrame], default: Callable[..., object] | None = None) -> None:
    if name in TASKS:
        raise ValueError(f"{name} exists")
    TASKS[name] = build
    if default is not None:
        DEFAULTS[name] = default


def task_labels(name: str, tables: Tables, **arguments) -> DataFrame:
    if name not in TASKS:
        raise NameError(f"{name} is not a known task")
    return TASKS[name](tables, **arguments)


def task_default(name: str, **arguments):
    """Label of a window that the task's table does not list."""
    return DEFAULTS[name](**arguments) if name in DEFAULTS else 0


def task_windows(
    name: str, windows: DataFrame, tables: Tables, fields: Sequence[str] = DEFAULT_FIELDS, *,
    normalize: bool = False, metadata: Sequence[str] = (), **arguments,
) -> DataFrame:
    """Windows labelled by a named task, and by further tasks as ``metadata`` columns, each with its own default."""
    return labelled_windows(
        windows, task_labels(name, tables, **arguments), fields, normalize=normalize, default=task_default(name, **arguments),
        metadata={m: (task_labels(m, tables), task_default(m)) for m in metadata},
    )


def labelled_windows(
    windows: DataFrame, labels: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS, *,
    normalize: bool = False, default=0, metadata: Mapping[str, DataFrame | tuple] | None = None, autoencoder: bool = False,
) -> DataFrame:
    """participant_id, id, date, end_date_str, channels and label of each window.

    ``normalize`` z-scores every numeric channel within its window. ``metadata``
    adds further label columns from other label tables, given as a table or as
    (table, default). An autoencoder's target is its input, hence no label lookup.
    """
    end = F.date_format(F.col("end") - F.expr("INTERVAL '0.001' SECOND"), "yyyy-MM-dd HH:mm:ss.SSS")
    channels = [
        window_zscore(c).alias(c) if normalize and _is_numeric(windows, c) else F.col(c) for c in fields
    ]
    rows = windows.select("participant_id", "id", label_date("end").alias("date"), end.alias("end_date_str"), *channels)
    if not autoencoder:
        keys = [c for c in ("participant_id", "date") if c in labels.columns]
        label_col = "features" if "features" in labels.columns else "label"
        rows = lookup_labels(rows, labels, label_col=label_col, default=default, keys=keys)
    for name, table in (metadata or {}).items():
        table, other = table if isinstance(table, tuple) else (table, 0)
        keys = [c for c in ("participant_id", "date") if c in table.columns]
        label_col = "features" if "features" in table.columns else "label"
        rows = lookup_labels(rows, table, label_col=label_col, default=other, keys=keys, alias=name)
    return rows


def _is_numeric(windows: DataFrame, channel: str) -> bool:
    kind = windows.schema[channel].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)


def channel_length(windows: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One row ``(length, n_channels)``; fails when channels or windows differ in length.

    Without a field list the numeric and flag arrays count, the id does not.
    """
    fields = list(
        fields or [f.name for f in windows.schema.fields if isinstance(f.dataType, T.ArrayType)]
    )
    missing = [f for f in fields if f not in windows.columns]
    if missing:
        raise ValueError(f"missing channels: {missing}")
    sizes = windows.select(F.explode(F.array(*[F.size(c) for c in fields])).alias("_n"))
    mixed = F.raise_error(F.lit("channels differ in length")).cast("int")
    return sizes.agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi")).select(
        F.when(F.col("_lo") == F.col("_hi"), F.col("_hi")).otherwise(mixed).alias("length"),
        F.lit(len(fields)).alias("n_channels"),
    )
