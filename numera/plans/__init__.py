"""Physical shapes that several operators share: segments, intervals, successor joins."""
