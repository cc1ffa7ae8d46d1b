"""quillscan: secret detection and findings analytics as Spark plans."""

__version__ = "0.1.0"
