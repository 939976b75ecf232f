"""Operators for preparing training text: fingerprints, quality, tokens, near copies, licences,
packing, language-model scores and page extraction. Nothing else in the library imports this package."""
