"""The health model."""

from __future__ import annotations

from lakemart.plans.model import Column, Model

# Names, source columns, types and default sums of the model.
HEALTH = Model(
    name="health",
    columns=(
        Column("Age", "AGE", "int64"),
        Column("Gender", "SEX", "int64"),
        Column("BMI", "BMI", "double", "sum"),
        Column("BP", "BP", "double", "sum"),
        Column("S1", "S1", "int64", "sum"),
        Column("S2", "S2", "double", "sum"),
        Column("S3", "S3", "double", "sum"),
        Column("S4", "S4", "double", "sum"),
        Column("S5", "S5", "double", "sum"),
        Column("S6", "S6", "int64", "sum"),
        Column("Y", "Y", "int64", "sum"),
    ),
)
