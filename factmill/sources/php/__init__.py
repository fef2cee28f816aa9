"""A reader of PHP source: tokens, syntax tree, facts, control flow. Plain Python, run per file inside tasks."""
