"""The type model of manifests, read from an XML Schema."""
