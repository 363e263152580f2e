"""Classify and extract: one record per document."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import choose_text
from paperloom.operators import boxes as bx
from paperloom.operators.extraction import extract_fields, gate
from paperloom.operators.scoring import named_predictions, ordered_predictions, primary
from paperloom.schemas import BOX_TYPE, FIELD_ORDER
from paperloom.sources.sinks import materialise
from paperloom.training.stacking import Features, all_predictions


def classify_and_extract(
    docs: DataFrame,
    preds: DataFrame,
    ocr: DataFrame,
    entities: DataFrame | None = None,
    force: bool = False,
) -> DataFrame:
    """``docs(doc_id, ocr_text, pdf_text)`` with long predictions and OCR words to final records.

    The gate sits before extraction, so patterns run on invoices only, and words of other documents
    leave at the first join with the fields.  The fields are stored once extracted: they are this
    job's product, small beside the texts, and read again to find the boxes.  Documents that are not invoices keep null fields and no boxes.
    """
    labelled = docs.join(primary(preds), "doc_id", "left").withColumn("label", F.coalesce("label", F.lit("-")))
    texts = gate(labelled, force).select("doc_id", choose_text(F.col("pdf_text"), F.col("ocr_text")).alias("text"))
    fields = materialise(extract_fields(texts, entities).drop("text"))
    located = bx.box_lists(fields, bx.span_boxes(bx.locate_fields(fields, ocr)))
    return labelled.select("doc_id", "label", "confidence").join(located, "doc_id", "left").select(
        "doc_id", "label", "confidence", *FIELD_ORDER, F.coalesce("boxes", F.array().cast(f"array<{BOX_TYPE}>")).alias("boxes")
    )


def score_and_extract(
    docs: DataFrame,
    features: Features,
    ocr: DataFrame,
    models: dict[str, PipelineModel],
    stack: PipelineModel,
    text_model: PipelineModel | None = None,
    entities: DataFrame | None = None,
) -> DataFrame:
    """From fitted models to records: :func:`classify_and_extract` on what the models say, with the list of all
    their predictions in ``predictions`` (empty where no model spoke).

    ``features`` hold the vectors of the documents' images; the text model reads the OCR text, as it was fitted on.
    """
    texts = docs.select("doc_id", F.col("ocr_text").alias("text"))
    preds = materialise(named_predictions(all_predictions(models, features, stack, text_model, texts)))
    listed = ordered_predictions(preds)
    kind = listed.schema["predictions"].dataType
    records = classify_and_extract(docs, preds, ocr, entities).join(listed, "doc_id", "left")
    return records.withColumn("predictions", F.coalesce("predictions", F.array().cast(kind)))
