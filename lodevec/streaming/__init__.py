"""The engine has no streaming operators. A stream is indexed batch by batch, with VectorIndex.insert in foreachBatch."""
