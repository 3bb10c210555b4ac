"""Corpus preparation operators. Nothing outside this subpackage imports it, apart from the registry at the top."""
