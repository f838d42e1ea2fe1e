"""File manifests and text extraction."""
