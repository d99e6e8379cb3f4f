"""Column expressions: text rules, prompts, answer and response parsing, vector math."""
