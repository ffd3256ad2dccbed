"""Plan building blocks: field paths, filters, skew-safe ordering."""
