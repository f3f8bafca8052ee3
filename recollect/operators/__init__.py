"""Jobs over subjects, episodes and memories."""
