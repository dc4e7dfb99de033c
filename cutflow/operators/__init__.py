"""DataFrame operators over shots, beats, intervals, vectors and tasks."""
