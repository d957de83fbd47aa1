"""Bilingual concordance analytics, expressed as Spark DataFrame plans."""
