"""Empty on purpose: no operator of this engine is a streaming one."""
