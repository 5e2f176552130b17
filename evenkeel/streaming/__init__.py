"""evenkeel.streaming"""
