"""evenkeel.sources"""
