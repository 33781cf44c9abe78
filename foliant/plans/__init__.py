"""Registered queries; importing the package registers all of them."""

from foliant.plans import blockviews, covers, evaluation, forms, hinting, outputs, profiles, registry, repairing, reviewing, rewriting, scalars, spanning, structure, trees, validating, xmltrees  # noqa: F401
