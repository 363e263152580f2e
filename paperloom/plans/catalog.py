"""All registered queries; importing the modules fills the registry."""

from paperloom.plans import boxes, corpus, evaluation, images, scoring, streaming, text, training  # noqa: F401
from paperloom.plans.registry import ORACLES, QUERIES  # noqa: F401
