"""Column expressions; all but the Arrow codecs stay inside whole-stage codegen."""
