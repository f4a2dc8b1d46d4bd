"""Part of atlaswright."""
