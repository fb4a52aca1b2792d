"""Part of hyperloom."""
