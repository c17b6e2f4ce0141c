"""Access semantics: facts, rules, rewriting, enforcement, generation, retrieval, evaluation."""
